"""Keyed collections: a DataFrame with a unique key and `ord`, its place. Rows are never kept in order otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelflow.session import cut


def keep_first(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Of rows with the same key the first. An aggregation with partial results, not a window: a hot key is no hot task."""
    rest = [c for c in df.columns if c not in (key, order)]
    if any(t.startswith(("map", "variant")) for n, t in df.dtypes if n in rest):
        w = Window.partitionBy(key).orderBy(order)
        return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    first = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("__r"))
    return first.select(key, "__r.*").select(*df.columns)


#: Keys of a caller's list that are broadcast at most; a longer list is joined by shuffle.
BROADCAST_KEYS = 100_000


def _asked(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def get(df: DataFrame, keys: list, key: str = "id") -> DataFrame:
    """A row for each asked key, in order, repeated ones too; place is the request's number; other columns are null for keys that aren't there."""
    ask = df.sparkSession.createDataFrame(list(enumerate(keys)), f"place bigint, __k {dict(df.dtypes)[key]}")
    return _asked(ask, len(keys)).join(df, F.col("__k") == F.col(key), "left").drop(key).withColumnRenamed("__k", key)


def numbered(df: DataFrame, order: str = "ord") -> DataFrame:
    """df with `at`, the row's number from 0. Rows are written in range partitions once; numbers come from a count of each, so no task holds all rows."""
    spark = df.sparkSession
    parts = cut(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__p", F.spark_partition_id()))
    w = Window.partitionBy("__p").orderBy(order)
    local = parts.withColumn("__n", F.row_number().over(w) - 1)
    counts = sorted((r["__p"], r["count"]) for r in parts.groupBy("__p").count().collect())  # as many rows as partitions
    total, before = 0, []
    for p, n in counts:
        before.append((p, total))
        total += n
    return local.join(F.broadcast(spark.createDataFrame(before or [(0, 0)], "__p int, __before bigint")), "__p").withColumn("at", F.col("__n") + F.col("__before")).select(*df.columns, "at")


def ranked(df: DataFrame, order: str = "ord") -> DataFrame:
    """df with `at`, for collections whose order fits one sort."""
    return df.withColumn("at", (F.row_number().over(Window.orderBy(order)) - 1).cast("bigint"))


def nth(df: DataFrame, i: int, order: str = "ord") -> DataFrame:
    """The i-th row, from the end if negative. IndexError outside. Only the first |i| rows are ever sorted."""
    asc = i >= 0
    n = i + 1 if asc else -i
    top = df.orderBy(F.asc(order) if asc else F.desc(order)).limit(n)
    if top.count() < n:
        raise IndexError(i)
    return top.orderBy(F.desc(order) if asc else F.asc(order)).limit(1)


def sliced(df: DataFrame, start: int | None, stop: int | None, step: int | None = None, order: str = "ord") -> DataFrame:
    """A slice as of a list; the result's `ord` counts from 0, so that a negative step turns the order."""
    r = range(*slice(start, stop, step).indices(df.count()))
    if not len(r):
        return df.limit(0)
    lo, hi = min(r[0], r[-1]), max(r[0], r[-1])
    x = numbered(df, order).where((F.col("at") >= lo) & (F.col("at") <= hi) & (F.abs(F.col("at") - r[0]) % abs(r.step) == 0))
    return x.withColumn(order, F.floor(F.abs(F.col("at") - r[0]) / abs(r.step))).drop("at")


def subset(df: DataFrame, indices: list[int], order: str = "ord") -> DataFrame:
    """Rows by number, in the asked order, repeated ones too."""
    ask = df.sparkSession.createDataFrame(list(enumerate(indices)), "place bigint, at bigint")
    return _asked(ask, len(indices)).join(numbered(df, order), "at")


def add(df: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Rows of new whose key isn't there, behind the others; what is there stays."""
    last = df.agg(F.coalesce(F.max(order), F.lit(-1)).alias("__last"))
    fresh = keep_first(new, key, order).join(df.select(key), key, "left_anti").crossJoin(F.broadcast(last))
    return df.unionByName(fresh.withColumn(order, F.col(order) + F.col("__last") + 1).select(*df.columns))


def put(df: DataFrame, new: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Rows of new replace those of the same key at their place; others come behind."""
    last = df.agg(F.coalesce(F.max(order), F.lit(-1)).alias("__last"))
    places = df.select(key, F.col(order).alias("__at"))
    placed = new.join(places, key, "left").crossJoin(F.broadcast(last)).withColumn(order, F.coalesce(F.col("__at"), F.col(order) + F.col("__last") + 1))
    return df.join(new.select(key), key, "left_anti").select(*df.columns).unionByName(placed.select(*df.columns))


def remove(df: DataFrame, keys: list | DataFrame, key: str = "id") -> DataFrame:
    if isinstance(keys, DataFrame):
        return df.join(keys.select(key), key, "left_anti")
    return df.where(~F.col(key).isin(list(keys)) | F.col(key).isNull())


def with_images(assets: DataFrame, images: DataFrame, key: str = "id", asset: str = "asset_id") -> DataFrame:
    """Assets that have an image."""
    return assets.join(images.select(F.col(asset).alias(key)), key, "left_semi")


def add_images(have: DataFrame, new: DataFrame) -> DataFrame:
    """Image rows (asset_id, ord, id, ..) added: an id that the asset has already is skipped; images without id always come behind."""
    keep = new.where("id is null").unionByName(new.where("id is not null").join(have.select("asset_id", "id"), ["asset_id", "id"], "left_anti").select(*new.columns))
    w = Window.partitionBy("asset_id", F.coalesce("id", F.concat(F.lit("\0"), F.col("ord").cast("string")))).orderBy("ord")
    keep = keep.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    last = have.groupBy("asset_id").agg(F.max("ord").alias("__last"))
    return have.unionByName(keep.join(last, "asset_id", "left").withColumn("ord", F.col("ord") + F.coalesce(F.col("__last"), F.lit(-1)) + 1).select(*have.columns))


def remove_images(have: DataFrame, names: list[str], file: Column) -> DataFrame:
    """Without, for each asset and name, the first image whose id or file name it is."""
    ask = F.explode(F.array(*map(F.lit, names))).alias("__name")
    hit = have.select("asset_id", "ord", "id", file.alias("__file"), ask).where("id = __name or __file = __name")
    gone = hit.groupBy("asset_id", "__name").agg(F.min("ord").alias("ord")).select("asset_id", "ord").distinct()
    return have.join(gone, ["asset_id", "ord"], "left_anti")


def find_images(have: DataFrame, names: list[str], file: Column) -> DataFrame:
    """place, and the image, for each asset and asked name that is an id or file name; of several the last."""
    ask = have.sparkSession.createDataFrame(list(enumerate(names)), "place bigint, __name string")
    both = have.select("*", F.explode(F.array_distinct(F.array(F.col("id"), file))).alias("__name"))
    w = Window.partitionBy("asset_id", "place").orderBy(F.desc("ord"))
    return both.join(_asked(ask, len(names)), "__name").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__name")
