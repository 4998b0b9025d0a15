"""Tiles, geodesy, projections and units as Column expressions: everything stays in generated code."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
MAX_MERCATOR_LAT = 85.05112878

UNIT_ALIASES = {
    **dict.fromkeys(("m", "meter", "meters", "metre", "metres"), "m"), **dict.fromkeys(("km", "kilometer", "kilometers", "kilometre"), "km"), **dict.fromkeys(("ft", "foot", "feet"), "ft"),
    **dict.fromkeys(("yd", "yard", "yards"), "yd"), **dict.fromkeys(("mi", "mile", "miles"), "mi"),
}
#: How many of each unit a metre has.
PER_METRE = {"m": 1.0, "km": 0.001, "ft": 1 / 0.3048, "yd": 1 / 0.9144, "mi": 1 / 1609.344}


def _d(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def to_metres(value: float, unit: str) -> float:
    """A length in metres. ValueError for unknown units."""
    key = UNIT_ALIASES.get(str(unit).strip().lower())
    if key is None:
        raise ValueError(f"Unsupported distance unit {unit!r}")
    return value / PER_METRE[key]


def tile_x(lon: Column, zoom) -> Column:
    """Fractional Web-Mercator tile column."""
    return (_d(lon) + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))


def tile_y(lat: Column, zoom) -> Column:
    """Fractional Web-Mercator tile row, from the north; latitudes aren't clamped."""
    return (1.0 - F.asinh(F.tan(F.radians(_d(lat)))) / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))


def tile_to_wgs84(sx: Column, sy: Column, tx: Column, ty: Column, zoom, extent: int = 4096) -> tuple[Column, Column]:
    """Longitude and latitude of a place (sx, sy) inside a tile of `extent` steps."""
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    lon = (_d(tx) + _d(sx) / extent) / n * 360.0 - 180.0
    return lon, F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * (_d(ty) + _d(sy) / extent) / n))))


def ms_to_date(ms: Column) -> Column:
    """The UTC date of epoch milliseconds (the session's time zone must be UTC)."""
    return F.to_date(F.timestamp_millis(ms.cast("bigint")))


def enclosing_zoom(minx: Column, miny: Column, maxx: Column, maxy: Column, low: int = 14, high: int = 22) -> Column:
    """Highest zoom from high to low whose tile holds the whole box, else low."""
    out = F.lit(low)
    for z in range(low, high + 1):
        same = (tile_x(minx, z).cast("bigint") == tile_x(maxx, z).cast("bigint")) & (tile_y(maxy, z).cast("bigint") == tile_y(miny, z).cast("bigint"))
        out = F.when(same, F.lit(z)).otherwise(out)
    return out


def cover_tiles(minx: Column, miny: Column, maxx: Column, maxy: Column, zoom) -> Column:
    """Array of struct<x,y,z> of the tiles that meet a box; indexes truncate towards zero."""
    z = zoom if isinstance(zoom, Column) else F.lit(zoom)
    xs = F.sequence(tile_x(minx, z).cast("bigint"), tile_x(maxx, z).cast("bigint"))
    ys = F.sequence(tile_y(maxy, z).cast("bigint"), tile_y(miny, z).cast("bigint"))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y"), z.cast("int").alias("z")))))


def pixel_xy(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Global pixel coordinates of 256-pixel tiles, truncated."""
    s = F.least(F.greatest(F.sin(F.radians(_d(lat))), F.lit(-0.9999)), F.lit(0.9999))
    size = float(256 << zoom)
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * size
    return ((_d(lon) + 180.0) / 360.0 * size).cast("bigint"), y.cast("bigint")


def pixel_to_lat_lon(px: Column, py: Column, zoom: int) -> tuple[Column, Column]:
    size = float(256 << zoom)
    lat = 90.0 - 360.0 * F.atan(F.exp((_d(py) / size - 0.5) * 2 * math.pi)) / math.pi
    return lat, 360.0 * (_d(px) / size - 0.5)


def quadkey(x: Column, y: Column, zoom: int) -> Column:
    """Base-4 digits of a tile, the coarsest level first."""
    digit = lambda i: (F.shiftright(x.cast("bigint"), i).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y.cast("bigint"), i).bitwiseAND(F.lit(1))).cast("string")
    return F.concat(*(digit(i) for i in range(zoom - 1, -1, -1))) if zoom else F.lit("")


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres; longitudes wrap at 180."""
    wrapped = F.pmod(_d(lon2) - _d(lon1) + 180.0, F.lit(360.0)) - 180.0
    dlat, dlon = F.radians(_d(lat2) - _d(lat1)), F.radians(wrapped)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(_d(lat1))) * F.cos(F.radians(_d(lat2))) * F.pow(F.sin(dlon / 2), 2)
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def local_xy(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular metres around (lon0, lat0), in doubles."""
    dlon = F.pmod(F.radians(_d(lon)) - F.radians(_d(lon0)) + math.pi, F.lit(2 * math.pi)) - math.pi
    return dlon * F.cos(F.radians(_d(lat0))) * EARTH_RADIUS_M, (F.radians(_d(lat)) - F.radians(_d(lat0))) * EARTH_RADIUS_M


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2, dl = F.radians(_d(lat1)), F.radians(_d(lat2)), F.radians(_d(lon2) - _d(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))), F.lit(360.0))


def heading(dx: Column, dy: Column) -> Column:
    """Direction of a vector: 0 north, clockwise."""
    return F.pmod(F.degrees(F.atan2(_d(dx), _d(dy))), F.lit(360.0))


def rotate_to_axis(x: Column, y: Column, axis_angle: Column) -> tuple[Column, Column]:
    """Coordinates with the axis of that heading along x."""
    t = -F.radians(F.pmod(90.0 - _d(axis_angle), F.lit(360.0)))
    return x * F.cos(t) - y * F.sin(t), x * F.sin(t) + y * F.cos(t)


def parse_buffer(buffer: float | str) -> tuple[str, float]:
    """('ratio', share), ('metres', length) or ('native', length). ValueError for anything else."""
    s = str(buffer).strip().lower()
    if s.endswith("%"):
        return "ratio", float(s.strip("%")) / 100.0
    if m := re.fullmatch(r"([\d.]+)\s*([a-z]+)", s):
        return "metres", to_metres(float(m[1]), m[2])
    if re.fullmatch(r"[\d.]+", s):
        return "native", float(s)
    raise ValueError(f"Could not parse buffer: {buffer!r}")


def buffered_bounds(minx: Column, miny: Column, maxx: Column, maxy: Column, buffer: float | str = "20%", square: bool = True, geographic: bool = False, metres_per_unit: float = 1.0) -> list[Column]:
    """A padded box (minx, miny, maxx, maxy). In degrees, x is stretched by the latitude's cosine; a point gets ten metres for a share."""
    kind, value = parse_buffer(buffer)
    cx, cy, w, h = (minx + maxx) / 2.0, (miny + maxy) / 2.0, maxx - minx, maxy - miny
    cos = F.greatest(F.lit(0.00001), F.cos(F.radians(cy))) if geographic else F.lit(1.0)
    longest = F.greatest(w * cos, h)
    unit = METRES_PER_DEGREE if geographic else metres_per_unit
    base = F.when(longest == 0, F.lit(10.0 / unit)).otherwise(longest * value) if kind == "ratio" else F.lit(value / unit if kind == "metres" else value)
    bx = base / cos
    if square:
        hx, hy = longest / 2.0 / cos + bx, longest / 2.0 + base
        return [cx - hx, cy - hy, cx + hx, cy + hy]
    return [minx - bx, miny - base, maxx + bx, maxy + base]


def raster_size(minx: Column, miny: Column, maxx: Column, maxy: Column, unit: str = "m") -> tuple[Column, Column]:
    """Width and height of a box in a unit, along its middle lines."""
    k = 1 / to_metres(1.0, unit)
    cx, cy = (minx + maxx) / 2.0, (miny + maxy) / 2.0
    return haversine_m(minx, cy, maxx, cy) * k, haversine_m(cx, miny, cx, maxy) * k


def patch_pixels(metres: float, step_x: Column, step_y: Column, lat: Column, geographic: bool = True, metres_per_unit: float = 1.0) -> tuple[Column, Column]:
    """How many pixels a length has, at least one; halves round to even."""
    mx, my = (step_x * METRES_PER_DEGREE * F.cos(F.radians(lat)), step_y * METRES_PER_DEGREE) if geographic else (step_x * metres_per_unit, step_y * metres_per_unit)
    px = lambda m: F.greatest(F.lit(1), F.bround(F.lit(metres) / m).cast("int"))
    return px(mx), px(my)


def as_wgs84(minx: Column, miny: Column, maxx: Column, maxy: Column) -> tuple[Column, list[Column]]:
    """Whether a box lies beyond degrees and so counts as Web-Mercator metres, and its corners in degrees."""
    metric = (minx < -180) | (maxx > 180) | (miny < -90) | (maxy > 90)
    r = 6_378_137.0
    lon = lambda x: F.when(metric, F.degrees(x / r)).otherwise(x)
    lat = lambda y: F.when(metric, F.degrees(2 * F.atan(F.exp(y / r)) - math.pi / 2)).otherwise(y)
    return metric, [lon(minx), lat(miny), lon(maxx), lat(maxy)]


def azimuthal_feet(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """Azimuthal equidistant feet (US survey) on the sphere around (lon0, lat0)."""
    p, p0, dl = F.radians(_d(lat)), F.radians(_d(lat0)), F.radians(_d(lon) - _d(lon0))
    c = F.acos(F.least(F.greatest(F.sin(p0) * F.sin(p) + F.cos(p0) * F.cos(p) * F.cos(dl), F.lit(-1.0)), F.lit(1.0)))
    k = F.when(c < 1e-12, F.lit(1.0)).otherwise(c / F.sin(c)) * EARTH_RADIUS_M * 3937.0 / 1200.0
    return k * F.cos(p) * F.sin(dl), k * (F.cos(p0) * F.sin(p) - F.sin(p0) * F.cos(p) * F.cos(dl))


def local_pixel(x: Column, y: Column, x0: Column, y0: Column, step_x: Column, step_y: Column, col_off: Column, row_off: Column) -> tuple[Column, Column]:
    """Pixel (column, row) of a place in a north-up raster, relative to a window."""
    return (x - x0) / step_x - col_off, (y0 - y) / step_y - row_off


def radiometric_scale(px: Column, low: Column, high: Column) -> Column:
    """A sample stretched from [low, high] to 0..255, clipped and truncated."""
    v = (px - low) / F.when(high > low, high - low) * 255.0
    return F.coalesce(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)), F.lit(0.0)).cast("int")
