"""Whole extractions, composed of the operators: street images of assets, aerial images of assets, assets from orthophotos, mosaics of aerial tiles. Pictures are written to folders that all workers share; what is fetched or asked of a model is written once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import boxes, geo
from parcelflow.models.base import Backend, infer
from parcelflow.operators import footprints, spatial
from parcelflow.session import cut
from parcelflow.sources import imagery, pictures, raster

IMAGE = ("id", "asset_id", "ord", "path", "props", "error")


def street_views(assets: DataFrame, cameras: DataFrame, metres: float = 60.0, tolerance: float = 10.0, most: int = 8, size: float = 0.0005, rays: Column | None = None) -> DataFrame:
    """id, event_id, angle, axis, place: of each asset (id, lon, lat, minx .. maxy in degrees, axis_angle: the heading of its major axis) the best camera (event_id, plon, plat) of each ray, with a clear view, at most `most` by priority."""
    own = [F.col(c).alias(f"own_{c}") for c in boxes.Box._fields]
    a = assets.select("id", "lon", "lat", "axis_angle", *own, (spatial.rays() if rays is None else rays).alias("rays"))
    c = spatial.camera_join(a, cameras, metres, keep=("axis_angle", *(f"own_{c}" for c in boxes.Box._fields), "rays"))
    x, y = geo.rotate_to_axis(F.col("x"), F.col("y"), F.col("axis_angle"))
    matched = spatial.match_rays(c.withColumns({"x": x, "y": y}), tolerance=tolerance)
    best = spatial.best_by_named_ray(spatial.localise(matched, assets, size))
    return spatial.capped(best, most).select("id", "event_id", "angle", "axis", "place")


def street_images(assets: DataFrame, cameras: DataFrame, fetch: imagery.Fetch, folder: str, **options) -> DataFrame:
    """IMAGE rows of the assets' street images: each view's picture (url of its camera) saved as folder/{asset}_{axis}.jpg. error: why a picture isn't there."""
    views = street_views(assets, cameras, **options).join(cameras.select("event_id", "url", *(c for c in ("plon", "plat") if c in cameras.columns)), "event_id")
    views = cut(views.withColumn("image_id", F.concat_ws("_", F.col("id").cast("string"), "axis")))
    got = cut(imagery.fetched(views, fetch, key="image_id"))
    path = F.concat(F.lit(f"{folder}/"), F.col("image_id"), F.lit(".jpg"))
    saved = cut(pictures.save_files(got.where("error is null").select(path.alias("path"), "content"), overwrite=True))
    props = F.to_json(F.struct("event_id", "axis", "angle", "place", "plon", "plat"))
    x = views.join(got.select("image_id", F.col("error").alias("__e")), "image_id").withColumn("path", path).join(saved.select("path", F.col("error").alias("__s")), "path", "left")
    return x.select(F.col("image_id").alias("id"), F.col("id").alias("asset_id"), F.col("place").alias("ord"), "path", props.alias("props"), F.coalesce("__e", "__s").alias("error"))


def aerial_images(spark: SparkSession, rasters: str, assets: DataFrame, folder: str, buffer: float | str = "20%", most_missing: float = 0.2, geographic: bool = True, square: bool = True) -> DataFrame:
    """IMAGE rows of the assets' windows in the rasters that they meet, scaled from p1 to p99 of each raster (of its first band) where it has more than 8 bits of use, saved as folder/{asset}_{raster}.jpg."""
    w = raster.patches(spark, rasters, assets, buffer, most_missing, square, geographic)
    stats = raster.statistics(spark, rasters).where("band = 0").select("path", "p1", "p99")
    px = raster.read_windows(w.join(stats, "path").select("id", "path", "row_off", "col_off", "w", "h", *boxes.Box._fields, "missing", "p1", "p99"))
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    image = F.concat_ws("_", F.col("id").cast("string"), name)
    px = px.withColumn("image_id", image).withColumn("source", F.col("path")).withColumn("path", F.concat(F.lit(f"{folder}/"), image, F.lit(".jpg")))
    files = pictures.encoded(px.drop("row_off", "col_off", "p1", "p99", "x0", "y0", "sx", "sy").withColumns({"h": F.col("h").cast("int"), "w": F.col("w").cast("int")}))
    files = cut(files)
    saved = cut(pictures.save_files(files.select("path", "content"), overwrite=True))
    props = F.to_json(F.struct("source", *boxes.Box._fields, "missing"))
    x = files.join(saved.select("path", "error"), "path")
    return x.select(F.col("image_id").alias("id"), F.col("id").alias("asset_id"), F.lit(0).cast("bigint").alias("ord"), "path", props.alias("props"), "error")


def ortho_assets(spark: SparkSession, rasters: str, backend: Callable[[], Backend], prompt: str, folder: str, size: float, patch: int = 512, overlap: float = 0.2, most_missing: float = 0.8, batch: int = 4, least_area: float = 0.0) -> DataFrame:
    """root, part, n, rings: what the model finds on the rasters' tiles, as polygons in map coordinates, those that meet over tile borders as one. The model's masks are polygons (lists of points in pixels of the tile), or where it has none its boxes. size: the cells of the overlap join, about a common outline's width."""
    t = raster.tiles(spark, rasters, patch, overlap, most_missing).drop("missing")
    path = F.concat(F.lit(f"{folder}/"), F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1), F.lit("_"), F.col("row_off").cast("string"), F.lit("_"), F.col("col_off").cast("string"), F.lit(".png"))
    px = raster.read_windows(t).withColumn("tile", path).drop("path", "row_off", "col_off").withColumns({"h": F.col("h").cast("int"), "w": F.col("w").cast("int")})
    files = cut(pictures.encoded(px, "png"))
    saved = cut(pictures.save_files(files.select(F.col("tile").alias("path"), "content"), overwrite=True)).where("error is null")
    todo = saved.select(F.col("path").alias("tile"), F.array("path").alias("paths"))
    got = cut(infer(todo, backend, prompt, key="tile", batch=batch)).where("status = 'ok'").join(files.select("tile", "x0", "y0", "sx", "sy"), "tile")
    masks = F.from_json("masks", "array<array<array<double>>>")
    corner = lambda b: F.array(*(F.array(b[i], b[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))))
    shapes = F.when(F.size(masks) > 0, masks).otherwise(F.transform(F.from_json("boxes", "array<array<double>>"), corner))
    each = got.select("tile", "x0", "y0", "sx", "sy", F.posexplode(shapes).alias("n", "shape"))
    points = F.transform("shape", lambda p: F.struct((F.col("x0") + p[0] * F.col("sx")).alias("x"), (F.col("y0") - p[1] * F.col("sy")).alias("y")))
    found = cut(each.select(F.concat_ws("#", "tile", F.col("n").cast("string")).alias("did"), F.array(F.concat(points, F.slice(points, 1, 1))).alias("rings")))
    whole = footprints.unioned(found, "did", size)
    return footprints.measure(whole).where(F.col("area") >= least_area).select("root", "part", "n", "rings") if least_area else whole


def _tile_pixels(tiles: DataFrame, fetch: imagery.Fetch, url: str, decode: Callable[[bytes], np.ndarray], size: int = 256) -> DataFrame:
    """Distinct tiles (x, y, z) fetched once, decoded to size x size x 3 bytes; pixels null where that fails."""
    keys = tiles.select("x", "y", "z").distinct()
    q = geo.quadkey(F.col("x"), F.col("y"), int(tiles.select("z").first()[0])) if "{quadkey}" in url else F.lit("")
    address = F.lit(url)
    for name, c in (("{x}", F.col("x").cast("string")), ("{y}", F.col("y").cast("string")), ("{z}", F.col("z").cast("string")), ("{quadkey}", q)):
        address = F.replace(address, F.lit(name), c)
    got = imagery.fetched(keys.select(F.concat_ws("/", "z", "x", "y").alias("key"), address.alias("url")), fetch, key="key")

    def run(it):
        for pdf in it:
            out = []
            for c in pdf["content"]:
                try:
                    px = decode(bytes(c))
                    px = np.repeat(px[..., None], 3, 2) if px.ndim == 2 else px[..., :3]
                    out.append(px.astype(np.uint8).tobytes() if px.shape == (size, size, 3) else None)
                except Exception:  # noqa: BLE001 - a tile that can't be read is black
                    out.append(None)
            yield pd.DataFrame({"key": pdf["key"], "pixels": out})

    return cut(got.mapInPandas(run, "key string, pixels binary"))


def mosaics(df: DataFrame, fetch: imagery.Fetch, url: str, zoom: int, buffer: float = 0.1, decode: Callable[[bytes], np.ndarray] = pictures.png_pixels) -> DataFrame:
    """id, x0, y0, h, w, channels, pixels: a picture of each row's buffered box (id, minx .. maxy in degrees), stitched of aerial tiles and cut to the box."""
    w = imagery.mosaic_windows(df.select("id", *boxes.Box._fields), zoom, buffer)
    px = _tile_pixels(w, fetch, url, decode)
    return pictures.stitched(w.withColumn("key", F.concat_ws("/", "z", "x", "y")).join(px, "key", "left"), "id")


def region_rasters(spark: SparkSession, box: tuple[float, float, float, float], fetch: imagery.Fetch, url: str, zoom: int, folder: str, block: int = 16, decode: Callable[[bytes], np.ndarray] = pictures.png_pixels) -> DataFrame:
    """path, status, error: a region's aerial tiles as GeoTIFFs in Web Mercator, one for each block x block of tiles, so that no machine holds the region. Names are folder/{block column}_{block row}.tif."""
    region = spark.createDataFrame([(0, *map(float, box))], "id int, minx double, miny double, maxx double, maxy double")
    w = imagery.mosaic_windows(region, zoom, 0.0)
    px = _tile_pixels(w, fetch, url, decode)
    b, side = 256 * block, 256
    name = F.concat_ws("_", F.floor(F.col("x") / block).cast("string"), F.floor(F.col("y") / block).cast("string"))
    cx, cy = F.floor(F.col("x") / block) * b, F.floor(F.col("y") / block) * b
    w = w.withColumns({"left": F.greatest("left", cx), "top": F.greatest("top", cy), "right": F.least("right", cx + b), "bottom": F.least("bottom", cy + b), "name": name})
    tiles = w.withColumn("key", F.concat_ws("/", "z", "x", "y")).join(px, "key", "left")
    step = 2 * 20037508.342789244 / (side << zoom)

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                a = np.frombuffer(bytes(r.pixels), np.uint8).reshape(r.h, r.w, 3)
                out.append((f"{folder}/{r.name}.tif", raster.encode(a, r.x0 * step - 20037508.342789244, 20037508.342789244 - r.y0 * step, step, step, 3857)))
            yield pd.DataFrame(out, columns=["path", "content"])

    return pictures.save_files(pictures.stitched(tiles, "name").mapInPandas(run, "path string, content binary"), overwrite=True)
