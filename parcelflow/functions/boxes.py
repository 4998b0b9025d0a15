"""Boxes and points: closed-form geometry as Column expressions. A box is (minx, miny, maxx, maxy)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    minx: Column
    miny: Column
    maxx: Column
    maxy: Column


def box(prefix: str = "", alias: str | None = None) -> Box:
    """The box in columns minx .. maxy, with a prefix or of a DataFrame alias."""
    at = f"{alias}." if alias else ""
    return Box(*(F.col(f"{at}{prefix}{c}") for c in Box._fields))


def literal(x0: float, y0: float, x1: float, y1: float) -> Box:
    """A constant box; corners may come in any order."""
    return Box(*(F.lit(v) for v in (min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1))))


def normalised(b: Box) -> Box:
    return Box(F.least(b.minx, b.maxx), F.least(b.miny, b.maxy), F.greatest(b.minx, b.maxx), F.greatest(b.miny, b.maxy))


def width(b: Box) -> Column:
    return b.maxx - b.minx


def height(b: Box) -> Column:
    return b.maxy - b.miny


def area(b: Box) -> Column:
    return width(b) * height(b)


def centroid(b: Box) -> tuple[Column, Column]:
    return (b.minx + b.maxx) / 2, (b.miny + b.maxy) / 2


def intersects(a: Box, b: Box) -> Column:
    """They share a point, borders count. The comparisons are plain, so Parquet statistics can prune."""
    return (a.minx <= b.maxx) & (a.maxx >= b.minx) & (a.miny <= b.maxy) & (a.maxy >= b.miny)


def disjoint(a: Box, b: Box) -> Column:
    return ~intersects(a, b)


def inner(a: Box, b: Box) -> Column:
    """Their interiors meet (both have an area)."""
    return (a.minx < b.maxx) & (a.maxx > b.minx) & (a.miny < b.maxy) & (a.maxy > b.miny)


def contains(a: Box, b: Box) -> Column:
    """b lies in a, and not on its border alone."""
    return (a.minx <= b.minx) & (a.miny <= b.miny) & (a.maxx >= b.maxx) & (a.maxy >= b.maxy) & (b.maxx > a.minx) & (b.minx < a.maxx) & (b.maxy > a.miny) & (b.miny < a.maxy)


def within(a: Box, b: Box) -> Column:
    return contains(b, a)


def touches(a: Box, b: Box) -> Column:
    return intersects(a, b) & ~_interiors(a, b)


def _interiors(a: Box, b: Box) -> Column:
    """Interiors meet, where either may be a point."""
    point = lambda s: (s.minx == s.maxx) & (s.miny == s.maxy)
    inside = lambda p, s: (s.minx < p.minx) & (p.minx < s.maxx) & (s.miny < p.miny) & (p.miny < s.maxy)
    return F.when(point(a) & point(b), (a.minx == b.minx) & (a.miny == b.miny)).when(point(a), inside(a, b)).when(point(b), inside(b, a)).otherwise(inner(a, b))


def overlaps(a: Box, b: Box) -> Column:
    """Interiors meet and neither holds the other."""
    return inner(a, b) & ~contains(a, b) & ~contains(b, a)


PREDICATES = {"intersects": intersects, "within": within, "contains": contains, "touches": touches, "disjoint": disjoint, "overlaps": overlaps}


def overlap_area(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.least(a.maxx, b.maxx) - F.greatest(a.minx, b.minx)) * F.greatest(zero, F.least(a.maxy, b.maxy) - F.greatest(a.miny, b.miny))


def iou(a: Box, b: Box) -> Column:
    i = overlap_area(a, b)
    return i / F.nullif(area(a) + area(b) - i, F.lit(0))


def distance(a: Box, b: Box) -> Column:
    """0 where they meet."""
    dx = F.greatest(F.lit(0.0), a.minx - b.maxx, b.minx - a.maxx)
    dy = F.greatest(F.lit(0.0), a.miny - b.maxy, b.miny - a.maxy)
    return F.sqrt(dx * dx + dy * dy)


def envelope(a: Box, b: Box) -> Box:
    return Box(F.least(a.minx, b.minx), F.least(a.miny, b.miny), F.greatest(a.maxx, b.maxx), F.greatest(a.maxy, b.maxy))


def buffer(b: Box, d) -> Box:
    """Grown by d; shrunk beyond nothing it turns over."""
    d = d if isinstance(d, Column) else F.lit(d)
    return normalised(Box(b.minx - d, b.miny - d, b.maxx + d, b.maxy + d))


def _struct(b: Box) -> Column:
    return F.struct(*(c.alias(n) for n, c in zip(Box._fields, b)))


def split(b: Box) -> Column:
    """Array of the quarters: bottom left, bottom right, top left, top right."""
    x, y = centroid(b)
    return F.array(_struct(Box(b.minx, b.miny, x, y)), _struct(Box(x, b.miny, b.maxx, y)), _struct(Box(b.minx, y, x, b.maxy)), _struct(Box(x, y, b.maxx, b.maxy)))


def tile_by_area(b: Box, most: float = 0.01) -> Column:
    """Array of equal tiles of at most that area, column by column; a box without area, or small enough, is its own tile."""
    w, h = width(b), height(b)
    n = F.ceil(w * h / most)
    cols, rows = F.ceil(F.sqrt(n * (w / h))).cast("int"), F.ceil(F.sqrt(n / (w / h))).cast("int")
    sx, sy = w / cols, h / rows
    tile = lambda i, j: _struct(Box(b.minx + i * sx, b.miny + j * sy, b.minx + (i + 1) * sx, b.miny + (j + 1) * sy))
    grid = F.flatten(F.transform(F.sequence(F.lit(0), cols - 1), lambda i: F.transform(F.sequence(F.lit(0), rows - 1), lambda j: tile(i, j))))
    return F.when((w <= 0) | (h <= 0) | (w * h <= most), F.array(_struct(Box(*(c.cast("double") for c in b))))).otherwise(grid)


def sight_overlap(x0: Column, y0: Column, x1: Column, y1: Column, b: Box) -> Column:
    """Share of the segment (x0, y0)-(x1, y1) that lies in the box, by slabs; 0 or less where none does."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    for p, q, low, high in ((x0, x1, b.minx, b.maxx), (y0, y1, b.miny, b.maxy)):
        d = (q - p).cast("double")
        a, c = (low - p) / F.nullif(d, F.lit(0.0)), (high - p) / F.nullif(d, F.lit(0.0))
        out = (d == 0) & ((p < low) | (p > high))
        lo = F.when(out, F.lit(2.0)).otherwise(F.greatest(lo, F.when(d != 0, F.least(a, c)).otherwise(F.lit(0.0))))
        hi = F.least(hi, F.when(d != 0, F.greatest(a, c)).otherwise(F.lit(1.0)))
    return hi - lo
