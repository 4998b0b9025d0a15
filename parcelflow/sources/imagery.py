"""Remote imagery: tile keys are a DataFrame, the workers fetch. The fetch function is the caller's (url -> bytes, raising where it fails), so tests and dry runs need no network."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import geo
from parcelflow.functions import text as X
from parcelflow.models.base import with_retry
from parcelflow.operators.keyed import keep_first
from parcelflow.session import cut

Fetch = Callable[[str], bytes]


def _varint(b: bytes, i: int) -> tuple[int, int]:
    n = s = 0
    while True:
        n |= (b[i] & 127) << s
        s, i = s + 7, i + 1
        if b[i - 1] < 128:
            return n, i


def _fields(b: bytes) -> Iterator[tuple[int, int, object]]:
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        else:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        yield key >> 3, kind, v


def _value(b: bytes) -> object:
    for f, _, v in _fields(b):
        if f == 1:
            return v.decode()
        if f == 2:
            return struct.unpack("<f", v)[0]
        if f == 3:
            return struct.unpack("<d", v)[0]
        if f == 6:
            return (v >> 1) ^ -(v & 1)
        if f == 7:
            return bool(v)
        return v
    return None


def decode_tile(data: bytes, layer: str = "image") -> tuple[int, list[dict]]:
    """extent, and the point features (sx, sy from the top left, properties) of a vector tile's layer; gzip is seen by its mark."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    for f, _, body in _fields(data):
        if f != 3:
            continue
        name, keys, values, feats, extent = "", [], [], [], 4096
        for g, _, v in _fields(body):
            if g == 1:
                name = v.decode()
            elif g == 2:
                feats.append(v)
            elif g == 3:
                keys.append(v.decode())
            elif g == 4:
                values.append(_value(v))
            elif g == 5:
                extent = v
        if name != layer:
            continue
        out = []
        for x in feats:
            tags, at, fid, kind = [], None, None, 0
            for g, _, v in _fields(x):
                if g == 1:
                    fid = v
                elif g == 2:
                    i = 0
                    while i < len(v):
                        n, i = _varint(v, i)
                        tags.append(n)
                elif g == 3:
                    kind = v
                elif g == 4 and kind in (0, 1):
                    _, i = _varint(v, 0)
                    sx, i = _varint(v, i)
                    sy, i = _varint(v, i)
                    at = [(s >> 1) ^ -(s & 1) for s in (sx, sy)]
            if at:
                out.append({"fid": fid, "sx": at[0], "sy": at[1], "props": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2])}})
        return extent, out
    return 4096, []


IMAGES = "ord bigint, id string, sx int, sy int, extent int, x bigint, y bigint, z int, captured_at bigint, creator_id string, props string, error string"


def tile_images(tiles: DataFrame, fetch: Fetch, url: str, layer: str = "image", tries: int = 5) -> DataFrame:
    """The features of vector tiles (x, y, z) with a place in each tile; a tile that can't be had gives one row with its error. url has {x}, {y}, {z}."""

    def run(it):
        import json

        for pdf in it:
            out = []
            for x, y, z in pdf[["x", "y", "z"]].itertuples(index=False):
                base = (int(x) << 36) + (int(y) << 12)
                try:
                    extent, feats = decode_tile(with_retry(lambda: fetch(url.format(x=x, y=y, z=z)), tries), layer)
                    for n, f in enumerate(feats):
                        p = f["props"]
                        out.append((base + n, str(p.get("id", f["fid"])), f["sx"], f["sy"], extent, x, y, z, p.get("captured_at"), None if p.get("creator_id") is None else str(p["creator_id"]), json.dumps({k: v for k, v in p.items() if k not in ("organization_id", "sequence_id")}), None))
                except Exception as e:  # noqa: BLE001 - a tile's failure is its result
                    out.append((base, None, None, None, None, x, y, z, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in IMAGES.split(", ")]).astype({"sx": "Int32", "sy": "Int32", "extent": "Int32", "captured_at": "Int64"})

    return tiles.mapInPandas(run, IMAGES)


def images_in_box(spark: SparkSession, box: tuple[float, float, float, float], fetch: Fetch, url: str, start: str | None = None, end: str | None = None, creator: str | None = None, zoom: int = 14, partitions: int = 10) -> DataFrame:
    """ord, id, plon, plat, capture_date, creator_id, props, error: the images of all tiles that the box meets, of repeated ids the first; a tile that can't be had is a row with its error and no id. As many fetches at once as partitions."""
    t = spark.range(1).select(F.explode(geo.cover_tiles(*(F.lit(float(v)) for v in box), zoom)).alias("t")).select("t.*").repartition(partitions)
    raw = cut(tile_images(t, fetch, url))  # fetched once, whatever reads it
    # one extent a layer: it comes with each row
    n = F.pow(F.lit(2.0), "z")
    lon = (F.col("x") + F.col("sx") / F.col("extent")) / n * 360.0 - 180.0
    lat = F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * (F.col("y") + F.col("sy") / F.col("extent")) / n))))
    day = geo.ms_to_date(F.col("captured_at"))
    rows = raw.select("ord", "id", lon.alias("plon"), lat.alias("plat"), day.alias("capture_date"), "creator_id", "props", "error")
    failed = rows.where("error is not null")
    rows = rows.where("error is null")
    if creator is not None:
        rows = rows.where(F.col("creator_id") == creator)
    return keep_first(rows.where(X.in_date_range(F.col("capture_date"), start, end))).unionByName(failed)


def fetched(rows: DataFrame, fetch: Fetch, key: str = "id", url: str = "url", tries: int = 5) -> DataFrame:
    """key, content, error: what the urls give; a failure is a row with its error."""

    def run(it):
        for pdf in it:
            out = []
            for k, u in pdf[[key, url]].itertuples(index=False):
                try:
                    out.append((k, with_retry(lambda u=u: fetch(u), tries), None))
                except Exception as e:  # noqa: BLE001 - a download's failure is its result
                    out.append((k, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "content", "error"])

    return rows.select(key, url).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, content binary, error string")


def images_by_id(spark: SparkSession, ids: list[str], fetch: Fetch, url: str, fields: list[str] | None = None, partitions: int = 10, tries: int = 5) -> DataFrame:
    """id, props (JSON), content, error of images by their ids, each once: their metadata (JSON at url, which has {id} and {fields}), then the picture at the address that the metadata gives. Either's failure is the row's error."""
    keys = spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string").repartition(partitions)
    asked = X.checked_fields(F.array(*map(F.lit, fields or X.IMAGE_FIELDS)))
    address = F.replace(F.replace(F.lit(url), F.lit("{id}"), F.col("id")), F.lit("{fields}"), F.array_join(asked, ","))
    meta = fetched(keys.withColumn("url", address), fetch, tries=tries)
    meta = cut(meta.select("id", F.decode("content", "UTF-8").alias("props"), "error"))
    found = meta.withColumn("url", F.get_json_object("props", "$.thumb_original_url"))
    got = fetched(found.where("url is not null"), fetch, tries=tries)
    none = F.when(F.col("props").isNotNull() & F.col("url").isNull(), "no address of a picture")
    return found.join(got.withColumnRenamed("error", "__e"), "id", "left").select("id", "props", "content", F.coalesce("error", "__e", none).alias("error"))


def mosaic_windows(df: DataFrame, zoom: int, buffer: float = 0.1, size: int = 256) -> DataFrame:
    """df (minx .. maxy in degrees) with left, top, right, bottom, the buffered box in global pixels, clamped to the map, and x, y, z of each tile that it meets."""
    w, h = (F.col("maxx") - F.col("minx")) * buffer, (F.col("maxy") - F.col("miny")) * buffer
    lon = lambda c: F.least(F.greatest(c, F.lit(-180.0)), F.lit(180.0))
    lat = lambda c: F.least(F.greatest(c, F.lit(-geo.MAX_MERCATOR_LAT)), F.lit(geo.MAX_MERCATOR_LAT))
    left, top = geo.pixel_xy(lat(F.col("maxy") + h), lon(F.col("minx") - w), zoom)
    right, bottom = geo.pixel_xy(lat(F.col("miny") - h), lon(F.col("maxx") + w), zoom)
    x = df.withColumns({"left": left, "top": top, "right": F.greatest(right, left + 1), "bottom": F.greatest(bottom, top + 1)})
    tiles = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size)))
    return x.withColumn("x", tiles("left", "right")).withColumn("y", tiles("top", "bottom")).withColumn("z", F.lit(zoom))


def aerial_tiles(spark: SparkSession, box: tuple[float, float, float, float], zoom: int = 20) -> DataFrame:
    """x, y, z, quadkey, and the box of each aerial tile that a region meets."""
    t = spark.range(1).select(F.explode(geo.cover_tiles(*(F.lit(float(v)) for v in box), zoom)).alias("t")).select("t.*")
    lon0, lat1 = geo.tile_to_wgs84(F.lit(0), F.lit(0), F.col("x"), F.col("y"), zoom)
    lon1, lat0 = geo.tile_to_wgs84(F.lit(0), F.lit(0), F.col("x") + 1, F.col("y") + 1, zoom)
    return t.select("x", "y", "z", geo.quadkey(F.col("x"), F.col("y"), zoom).alias("quadkey"), lon0.alias("minx"), lat0.alias("miny"), lon1.alias("maxx"), lat1.alias("maxy"))


def present(spark: SparkSession, rows: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """Rows whose file is in the folder and isn't empty: a semi-join with the listing; contents aren't read."""
    have = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length").where("length > 0")
    clean = F.regexp_replace(F.col("path"), "^file:/+", "/")
    return rows.join(have.select(clean.alias("__p")), F.regexp_replace(F.col(path), "^file:/+", "/") == F.col("__p"), "left_semi")
