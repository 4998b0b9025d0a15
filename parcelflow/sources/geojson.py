"""GeoJSON: collections and features to asset rows and back.

A collection file is one JSON value, so it is one row until its features are exploded; for large data use features line by
line (lines=True), which split like any text file.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import attrs as A
from parcelflow.operators.keyed import keep_first
from parcelflow.session import spread

POINT = "struct<x:double,y:double>"
GEOMETRY = f"struct<type:string,parts:array<array<array<{POINT}>>>>"


def geometry(v: Column) -> Column:
    """GEOMETRY of a GeoJSON geometry variant; null if it is missing, empty, malformed or of an unknown type."""
    kind = F.try_variant_get(v, "$.type", "string")
    get = lambda t: F.try_variant_get(v, "$.coordinates", t)
    pt = lambda c: F.struct(F.try_element_at(c, F.lit(1)).alias("x"), F.try_element_at(c, F.lit(2)).alias("y"))
    ring = lambda r: F.transform(r, pt)
    d1, d2, d3, d4 = ("array<" * n + "double" + ">" * n for n in (1, 2, 3, 4))
    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(pt(get(d1))))))
        .when(kind == "MultiPoint", F.transform(get(d2), lambda c: F.array(F.array(pt(c)))))
        .when(kind == "LineString", F.array(F.array(ring(get(d2)))))
        .when(kind == "MultiLineString", F.transform(get(d3), lambda r: F.array(ring(r))))
        .when(kind == "Polygon", F.array(F.transform(get(d3), ring)))
        .when(kind == "MultiPolygon", F.transform(get(d4), lambda p: F.transform(p, ring)))
    )
    flat = F.flatten(F.flatten(parts))
    sound = (F.size(flat) > 0) & F.forall(flat, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    rings = F.when(kind.isin("Polygon", "MultiPolygon"), F.forall(F.flatten(parts), lambda r: F.size(r) >= 4)).when(kind.isin("LineString", "MultiLineString"), F.forall(F.flatten(parts), lambda r: F.size(r) >= 2)).otherwise(F.lit(True))
    return F.when(sound & rings, F.struct(kind.alias("type"), parts.alias("parts")))


def bounds(geom: Column) -> list[Column]:
    xs = F.transform(F.flatten(F.flatten(geom["parts"])), lambda p: p["x"])
    ys = F.transform(F.flatten(F.flatten(geom["parts"])), lambda p: p["y"])
    return [F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy")]


def single_part(geom: Column) -> Column:
    """A MultiPolygon of one part as that Polygon."""
    return F.when((geom["type"] == "MultiPolygon") & (F.size(geom["parts"]) == 1), F.struct(F.lit("Polygon").alias("type"), geom["parts"].alias("parts"))).otherwise(geom)


def _assets(features: DataFrame, asset_type: str | None, overwrite: bool) -> DataFrame:
    """features: ord, f (variant)."""
    text = lambda p: F.try_variant_get("f", p, "string")
    fid = F.coalesce(text("$.id"), text("$.properties.id"), F.concat(F.lit("gen_"), F.uuid()))
    props = F.coalesce(F.try_variant_get("f", "$.properties", "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    x = features.select(fid.alias("id"), "ord", geometry(F.try_variant_get("f", "$.geometry", "variant")).alias("geom"), (A.with_type(props, asset_type, overwrite) if asset_type else props).alias("attrs"))
    x = x.where("geom is not null and trim(id) <> ''")
    return keep_first(x).select("id", "ord", "geom", *bounds(F.col("geom")), "attrs")


def read(spark: SparkSession, source: str | dict, asset_type: str | None = None, overwrite_asset_type: bool = False, lines: bool = False) -> DataFrame:
    """id, ord, geom, minx .. maxy, attrs of a FeatureCollection in a file, a folder of files or a dict, or of features line by line.

    Features without a sound geometry are left out; of a repeated id the first stays; a feature without id gets one. TypeError
    for other sources, ValueError for a dict that is no FeatureCollection; a path that isn't there fails as Spark's reader does.
    """
    if isinstance(source, dict):
        if source.get("type") != "FeatureCollection":
            raise ValueError("not a FeatureCollection")
        if not isinstance(source.get("features"), list):
            raise ValueError("features must be a list")
        raw = spark.createDataFrame([(json.dumps(source),)], "value string")
    elif isinstance(source, (str, os.PathLike)):
        raw = spark.read.text(str(source), wholetext=not lines)
    else:
        raise TypeError("source must be a path or a dict")
    if lines:
        at = F.struct(F.input_file_name(), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        feats = raw.select(F.monotonically_increasing_id().alias("ord"), F.try_parse_json("value").alias("f"), at.alias("at")).select("ord", "f")
    else:
        whole = raw.select(F.try_parse_json("value").alias("v"))
        if not isinstance(source, dict):
            kind = F.coalesce(F.try_variant_get("v", "$.type", "string"), F.lit("none"))
            whole = whole.select(F.when(kind != "FeatureCollection", F.raise_error(F.lit("not a FeatureCollection")).cast("variant")).otherwise(F.col("v")).alias("v"))
        feats = whole.select(F.posexplode(F.try_variant_get("v", "$.features", "array<variant>")).alias("ord", "f")).select(F.col("ord").cast("bigint").alias("ord"), "f")
    return _assets(feats, asset_type, overwrite_asset_type)


def read_feature(spark: SparkSession, feature: dict, asset_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The asset row and its image rows of one feature. The id is the argument, else the feature's or its property (empty ones and 0 don't count), else made up. Images without a path are left out."""
    if feature.get("type") != "Feature":
        raise ValueError("not a Feature")
    if not feature.get("geometry"):
        raise ValueError("a feature needs a geometry")
    import uuid

    props = dict(feature.get("properties") or {})
    images = props.pop("image_assets", None) or []
    own = str(asset_id or feature.get("id") or props.get("id") or f"no_id_{uuid.uuid4().hex[:8]}")
    body = json.dumps({"type": "Feature", "id": own, "geometry": feature["geometry"], "properties": props})
    one = spark.createDataFrame([(0, body)], "ord bigint, b string").select("ord", F.parse_json("b").alias("f"))
    asset = _assets(one, None, False).withColumn("geom", single_part(F.col("geom")))
    rows = [(own, k, i.get("id"), i["path"], json.dumps({n: v for n, v in i.items() if n not in ("id", "path")}, default=str)) for k, i in enumerate(images) if isinstance(i, dict) and i.get("path")]
    img = spark.createDataFrame(rows, "asset_id string, ord bigint, id string, path string, p string")
    return asset, img.select("asset_id", "ord", F.coalesce("id", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("id"), "path", F.from_json("p", "map<string,variant>").alias("props"))


def coordinates_json(geom: Column) -> Column:
    """The coordinates as GeoJSON text."""
    pt = lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))
    arr = lambda xs: F.concat(F.lit("["), F.array_join(xs, ","), F.lit("]"))
    ring = lambda r: arr(F.transform(r, pt))
    parts = geom["parts"]
    t = geom["type"]
    return (
        F.when(t == "Point", pt(parts[0][0][0]))
        .when(t == "MultiPoint", arr(F.transform(parts, lambda p: pt(p[0][0]))))
        .when(t == "LineString", ring(parts[0][0]))
        .when(t == "MultiLineString", arr(F.transform(parts, lambda p: ring(p[0]))))
        .when(t == "Polygon", arr(F.transform(parts[0], ring)))
        .otherwise(arr(F.transform(parts, lambda p: arr(F.transform(p, ring)))))
    )


def features(assets: DataFrame, images: DataFrame | None = None, ignore: list[str] | None = None) -> DataFrame:
    """ord, feature: each asset as GeoJSON text, made in spread tasks. Its images are a property image_assets, if it has any and that isn't ignored."""
    skip = list(ignore or [])
    a = spread(assets.select("id", "ord", "geom", A.without(F.col("attrs"), *skip).alias("attrs")))
    if images is not None and "image_assets" not in skip:
        own = F.struct("ord", "id", "path", "props")
        i = images.groupBy("asset_id").agg(F.sort_array(F.collect_list(own)).alias("i")) if "props" not in images.columns else images.select("asset_id", F.struct("ord", F.to_json(F.struct("id", "path", "props")).alias("j")).alias("e")).groupBy("asset_id").agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["j"]).alias("i"))
        a = a.join(i.withColumnRenamed("asset_id", "id"), "id", "left")
        extra = F.when(F.size("i") > 0, F.concat(F.lit('"image_assets":['), F.array_join("i", ","), F.lit("]")))
    else:
        extra = F.lit(None).cast("string")
    pairs = F.transform(F.map_entries("attrs"), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    body = F.concat_ws(",", pairs, extra)
    ident = F.to_json(F.struct(F.col("id"))).substr(F.lit(2), F.length(F.to_json(F.struct(F.col("id")))) - 2)
    text = F.concat(F.lit('{"type":"Feature",'), ident, F.lit(',"geometry":{"type":"'), F.col("geom.type"), F.lit('","coordinates":'), coordinates_json(F.col("geom")), F.lit('},"properties":{'), body, F.lit("}}"))
    return a.select("ord", text.alias("feature"))


def collection(assets: DataFrame, images: DataFrame | None = None, ignore: list[str] | None = None) -> dict:
    """A FeatureCollection on the driver: for results that a person looks at."""
    rows = features(assets, images, ignore).orderBy("ord").select("feature").collect()
    return {"type": "FeatureCollection", "features": [json.loads(r[0]) for r in rows]}


def write_lines(assets: DataFrame, path: str, images: DataFrame | None = None, ignore: list[str] | None = None) -> None:
    """One feature a line, as many files as partitions."""
    features(assets, images, ignore).select("feature").write.mode("overwrite").text(path)
