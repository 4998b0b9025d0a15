"""Whole-collection operators: filters by place, summaries, exports, annotated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelflow.functions import attrs as A
from parcelflow.functions import boxes


def filter_by_box(df: DataFrame, box: boxes.Box, predicate: str = "intersects") -> DataFrame:
    """Rows whose box stands so to the search box. The comparisons with constants reach the Parquet scan."""
    if predicate not in boxes.PREDICATES:
        raise ValueError(f"Unsupported predicate {predicate!r}; one of {', '.join(boxes.PREDICATES)}")
    own = boxes.box()
    out = df if predicate == "disjoint" else df.where(boxes.intersects(own, box))
    return out.where(boxes.PREDICATES[predicate](own, box))


def filter_by_location(df: DataFrame, box: boxes.Box, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Images in a box, borders count; without a place they are out."""
    return df.where(F.col(lon).between(box.minx, box.maxx) & F.col(lat).between(box.miny, box.maxy))


def filter_labels(df: DataFrame, labels: Column, required: list[str]) -> DataFrame:
    """Images that show one of the required labels; an empty list requires nothing."""
    return df.where(F.arrays_overlap(labels, F.array(*map(F.lit, required)))) if required else df


def summary(df: DataFrame, image_count: Column | None = None) -> DataFrame:
    """A row for each resolved type, and one for all with type null: assets, images, bounds. One aggregation."""
    t = A.resolved_type(F.col("attrs")).alias("asset_type")
    x = df.select(t, *boxes.Box._fields, (image_count if image_count is not None else F.lit(0)).cast("bigint").alias("__n"))
    agg = [F.count(F.lit(1)).alias("assets"), F.sum("__n").alias("images"), F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy")]
    return x.rollup("asset_type").agg(*agg)


def combined_box(df: DataFrame) -> DataFrame:
    return df.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def to_table(df: DataFrame, keys: list[str], types: dict[str, str], image_count: Column | None = None) -> DataFrame:
    """Attributes as columns, then id, asset_type, geometry_wkt, image_count over attributes of the same names. keys come from the caller (or distinct_keys), so the plan has a fixed schema."""
    own = {"id", "asset_type", "geometry_wkt", "image_count"}
    v = lambda k: F.try_variant_get(A.value(F.col("attrs"), k), "$", types.get(k, "string")).alias(k)
    wkt = wkt_of_box(boxes.box())
    return df.select(*(v(k) for k in keys if k not in own), "id", A.resolved_type(F.col("attrs")).alias("asset_type"), wkt.alias("geometry_wkt"), (image_count if image_count is not None else F.lit(0)).cast("bigint").alias("image_count"))


def distinct_keys(df: DataFrame) -> list[str]:
    """Attribute keys in order of first sight; there are few, so they come to the driver."""
    rows = df.select("ord", F.posexplode(F.map_keys("attrs"))).groupBy("col").agg(F.min(F.struct("ord", "pos")).alias("at")).orderBy("at").collect()
    return [r["col"] for r in rows]


def wkt_of_box(b: boxes.Box) -> Column:
    pt = lambda x, y: F.concat(x.cast("string"), F.lit(" "), y.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", pt(b.maxx, b.miny), pt(b.maxx, b.maxy), pt(b.minx, b.maxy), pt(b.minx, b.miny), pt(b.maxx, b.miny)), F.lit("))"))


def median_width(samples: DataFrame, key: str, width: str, least: float = 22.0) -> DataFrame:
    return samples.groupBy(key).agg(F.greatest(F.median(width), F.lit(least)).alias("width"))


def robust_range(df: DataFrame, key: str, px: str) -> DataFrame:
    """p1 and p99 of each group, exact, with linear interpolation."""
    return df.groupBy(key).agg(F.percentile(px, 0.01).alias("p1"), F.percentile(px, 0.99).alias("p99"))


def valid_images(df: DataFrame, key: str, px: str, nodata: Column, most: float) -> DataFrame:
    """Keys whose share of missing pixels is under `most`."""
    return df.groupBy(key).agg(F.avg((F.col(px) == nodata).cast("double")).alias("missing")).where(F.col("missing") < most)


def first_seen_ids(df: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """Dense ids from 1 by the labels' first place in each group."""
    first = df.groupBy(group, label).agg(F.min(order).alias("__at"))
    return first.withColumn("label_id", F.dense_rank().over(Window.partitionBy(group).orderBy("__at"))).drop("__at")


def sliding_tiles(df: DataFrame, width: Column, height: Column, patch: int = 512, overlap: float = 0.2) -> DataFrame:
    """df with row_off, col_off of each window, row by row, and w, h, clipped at the edges."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap_ratio must be in [0, 1)")
    stride = max(1, int(patch * (1 - overlap)))
    at = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1, F.lit(stride).cast("bigint")))
    x = df.withColumn("row_off", at(height)).withColumn("col_off", at(width))
    return x.withColumn("w", F.least(F.lit(patch).cast("bigint"), width - F.col("col_off"))).withColumn("h", F.least(F.lit(patch).cast("bigint"), height - F.col("row_off")))


def crop_window(bearings: DataFrame, width: int, margin: float = 5.0) -> DataFrame:
    """key, left, right: pixel columns of a panorama that show the target, whose centre column is north; the largest gap between bearings is outside, so a target over the seam has right <= left."""
    from parcelflow.operators.spatial import circular_gap

    g = circular_gap(bearings, "key", "bearing")
    start, end = F.col("after") + F.col("gap") - margin, F.col("after") + margin
    px = lambda a: F.floor(F.pmod(a + 180.0, F.lit(360.0)) / 360.0 * width)
    return g.select("key", px(start.cast("double")).alias("left"), px(end.cast("double")).alias("right"))


def content_rows(rows: DataFrame, key: str, row: str, content: Column, vehicle: Column) -> DataFrame:
    """key, first_content, first_vehicle: the first row of each picture that has content, and that has the survey vehicle."""
    return rows.groupBy(key).agg(F.min(F.when(content, F.col(row))).alias("first_content"), F.min(F.when(vehicle, F.col(row))).alias("first_vehicle"))


def crop_rows(height: Column, first_content: Column, first_vehicle: Column, sky: float = 0.25, padding: float = 0.01) -> tuple[Column, Column]:
    """top, bottom of a panorama's crop: the sky's share goes, and what is above the first content row less the padding if that is more; the vehicle's rows go. Without content, or where top would be at bottom or below, only the sky goes."""
    base, pad = F.floor(height * sky), F.floor(height * padding)
    top = F.greatest(base, F.greatest(F.lit(0), first_content - pad))
    bottom = F.when(first_vehicle.isNotNull(), F.greatest(F.lit(0), first_vehicle - pad)).otherwise(height)
    smart = first_content.isNotNull() & (top < bottom)
    return F.when(smart, top).otherwise(base), F.when(smart, bottom).otherwise(height)


def largest_part(parts: DataFrame, key: str, part: str, area: Column, order: str) -> DataFrame:
    """key, part of largest area; of equal ones the first."""
    return parts.groupBy(key).agg(F.max_by(part, F.struct(area, -F.col(order))).alias(part))


def distinct_types(df: DataFrame) -> DataFrame:
    """The asset types that there are."""
    return df.select(A.asset_type(F.col("attrs")).alias("asset_type")).where("asset_type is not null").distinct()


def least_area(df: DataFrame, more_than: float) -> DataFrame:
    """df with the area of its boxes, of those with more."""
    return df.withColumn("area", boxes.area(boxes.box())).where(F.col("area") > more_than)


def scatter(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Rows with the model's results for them, joined by key; rows without a result are out."""
    return rows.join(results, key)


def map_labels(df: DataFrame, mapping: dict[str, str], column: str = "asset_type") -> DataFrame:
    """df with a column `label` from the caller's mapping, null for what it doesn't have. The mapping becomes an expression: no join."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return df.withColumn("label", F.try_element_at(F.create_map(*pairs), F.col(column)) if pairs else F.lit(None).cast("string"))


def first_of(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("__n") <= most).drop("__n")


def largest_first(df: DataFrame, key: str, area: Column, order: str) -> DataFrame:
    """df with place, from 1, by area within the key, largest first."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(area.desc(), order)))


def joined_prompts(df: DataFrame, key: str, label: str) -> DataFrame:
    """key, prompt: its labels, each once and in order, as one prompt."""
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(label)), ". ").alias("prompt"))


def approx_width(least: float = 10.0) -> Column:
    """A road's width from its box: twice the area by the perimeter."""
    b = boxes.box()
    return F.greatest(F.lit(least), F.round(2 * boxes.area(b) / (2.0 * (boxes.width(b) + boxes.height(b))), 6))


def summary_text(df: DataFrame, image_count: Column | None = None) -> str:
    """The summary as lines of text: assets, images, bounds, and a line for each type, most frequent first. Only one row a type comes to the driver."""
    rows = sorted(summary(df, image_count).collect(), key=lambda r: (r["asset_type"] is not None, -r["assets"], r["asset_type"] or ""))
    if not rows or not rows[0]["assets"]:
        return "empty collection"
    t = rows[0]
    lines = [f"assets: {t['assets']}", f"images: {t['images']}", f"bounds: ({t['minx']}, {t['miny']}) to ({t['maxx']}, {t['maxy']})"]
    return "\n".join(lines + [f"  {r['asset_type']}: {r['assets']} assets, {r['images']} images" for r in rows[1:]])
