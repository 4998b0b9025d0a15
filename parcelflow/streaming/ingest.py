"""Streams of image metadata: deduplicated by id within a watermark, joined to assets' cells, counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_images(stream: DataFrame, late: str = "10 minutes", key: str = "event_id", at: str = "ts") -> DataFrame:
    """Each id once within the watermark; state older than it goes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes", by: str = "event_type", at: str = "ts") -> DataFrame:
    """Images of each kind and window."""
    w = F.window(at, window)
    return stream.withWatermark(at, late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def near_assets(stream: DataFrame, assets: DataFrame, size: float) -> DataFrame:
    """Stream rows (px, py) with the assets whose box holds them: a stream-static equi-join on grid cells."""
    cell = lambda c: F.floor(c / F.lit(float(size))).cast("bigint")
    a = assets.withColumn("cx", F.explode(F.sequence(cell(F.col("minx")), cell(F.col("maxx"))))).withColumn("cy", F.explode(F.sequence(cell(F.col("miny")), cell(F.col("maxy")))))
    s = stream.withColumn("cx", cell(F.col("px"))).withColumn("cy", cell(F.col("py")))
    return s.join(a, ["cx", "cy"]).where("px between minx and maxx and py between miny and maxy").drop("cx", "cy")
