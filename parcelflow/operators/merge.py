"""Keyed merges of collections and of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRATEGIES = ("skip", "overwrite", "raise")


def merge(left: DataFrame, right: DataFrame, strategy: str = "skip", key: str = "id", order: str = "ord") -> DataFrame:
    """Both collections: rows of left at their places, new ones of right behind them. Of a key in both, left's row counts (skip), or right's at left's place (overwrite); raise fails before anything is merged. One full outer join."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Unknown conflict strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    if strategy == "raise" and not left.join(right.select(key), key, "left_semi").isEmpty():
        raise ValueError("Duplicate ids in merge")
    rest = [c for c in left.columns if c not in (key, order)]
    l, r = left.select(key, F.struct(*left.columns).alias("__l")), right.select(key, F.struct(*left.columns).alias("__r"))
    last = left.agg(F.coalesce(F.max(order), F.lit(-1)).alias("__last"))
    j = l.join(r, key, "full_outer").crossJoin(F.broadcast(last))  # one row
    own = F.coalesce("__l", "__r") if strategy != "overwrite" else F.coalesce("__r", "__l")
    place = F.coalesce(F.col(f"__l.{order}"), F.col(f"__r.{order}") + F.col("__last") + 1)
    return j.select(key, place.alias(order), own.alias("__row")).select(key, order, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*left.columns)


def merge_stats(left: DataFrame, right: DataFrame, strategy: str = "skip", key: str = "id") -> DataFrame:
    """added, overwritten, skipped."""
    j = right.select(key, F.lit(True).alias("__r")).join(left.select(key, F.lit(True).alias("__l")), key, "left")
    both = F.count_if(F.col("__l").isNotNull())
    none = F.lit(0).cast("bigint")
    return j.agg(F.count_if(F.col("__l").isNull()).alias("added"), (both if strategy == "overwrite" else none).alias("overwritten"), (none if strategy == "overwrite" else both).alias("skipped"))


def upsert(old: Column, new: Column, overwrite: bool) -> Column:
    """One map of two: of keys in both new's value if overwrite, else old's. Null maps count as empty."""
    if overwrite:
        old, new = new, old
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(old, F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k))))


def merge_images(left: DataFrame, right: DataFrame, overwrite_path: bool = False, overwrite_props: bool = True, add_new: bool = False) -> DataFrame:
    """Images (id, ord, path, props, ..) with right's properties taken in; status: merged, kept, added or skipped (those of right that aren't taken in come as rows too)."""
    r = right.select("id", F.col("path").alias("__path"), F.col("props").alias("__props"), F.col("ord").alias("__ord"), F.lit(True).alias("__r"))
    last = left.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("__last"))
    j = left.withColumn("__l", F.lit(True)).join(r, "id", "full_outer").crossJoin(F.broadcast(last))
    both = F.col("__l") & F.col("__r")
    status = F.when(both, "merged").when(F.col("__l"), "kept").when(F.lit(add_new), "added").otherwise("skipped")
    path = F.when(both & F.lit(overwrite_path), F.coalesce("__path", "path")).otherwise(F.coalesce("path", "__path"))
    return j.select(
        "id", F.coalesce(F.col("ord"), F.col("__ord") + F.col("__last") + 1).alias("ord"), path.alias("path"), upsert(F.col("props"), F.col("__props"), overwrite_props).alias("props"), status.alias("status")
    )


def collect_images(images: DataFrame) -> DataFrame:
    """All assets' images as one collection: of equal ids the first stays and takes properties that it lacks from later ones. images: asset_ord, ord, id, path, props."""
    at = F.struct("asset_ord", "ord")
    first = images.groupBy("id").agg(F.min(F.struct(at.alias("at"), F.col("path"))).alias("f"), F.count(F.lit(1)).alias("copies"))
    props = images.select("id", at.alias("at"), F.explode("props")).groupBy("id", "key").agg(F.min_by("value", "at").alias("value"))
    props = props.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("props"))
    return first.join(props, "id", "left").select("id", F.col("f.at.asset_ord").alias("asset_ord"), F.col("f.at.ord").alias("ord"), F.col("f.path").alias("path"), "props", "copies")


def intersect_labels(found: Column, valid: Column) -> Column:
    return F.array_intersect(found, valid)
