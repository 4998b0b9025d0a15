"""Spatial joins by cells: both sides go to the grid cells that they meet, an equi-join on the cell finds candidates, exact predicates refine. No nested-loop join; a hot cell is split by AQE like any skewed key."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelflow.functions import boxes, geo
from parcelflow.functions.boxes import Box
from parcelflow.session import cut


#: For joins whose sides both grow. Before it runs Spark knows a side by the bytes of its file, packed and not exploded, and would broadcast millions of rows.
MERGE = "merge"


def _cells(df: DataFrame, b: Box, size: float) -> DataFrame:
    """A row for each cell of a box: __cx, __cy, and __x0, __y0, its first cell."""
    at = lambda v: F.floor(v / F.lit(float(size))).cast("bigint")
    first = df.withColumn("__x0", at(b.minx)).withColumn("__y0", at(b.miny))
    return first.withColumn("__cx", F.explode(F.sequence(F.col("__x0"), at(b.maxx)))).withColumn("__cy", F.explode(F.sequence(F.col("__y0"), at(b.maxy))))


def box_join(left: DataFrame, right: DataFrame, size: float, on: Column | None = None, how: str = "inner", left_prefix: str = "l_", right_prefix: str = "r_", inner_only: bool = False, few: bool = False) -> DataFrame:
    """Pairs of rows whose boxes meet. Columns come with prefixes; size: the cells' edge, about a common box's. A pair that shares cells is reported in one of them, the first that both have. few: the right side is a short list, which may be broadcast."""
    l = left.select(*(F.col(c).alias(left_prefix + c) for c in left.columns))
    r = right.select(*(F.col(c).alias(right_prefix + c) for c in right.columns))
    a, b = boxes.box(left_prefix), boxes.box(right_prefix)
    lc = _cells(l, a, size).withColumnsRenamed({"__x0": "__lx", "__y0": "__ly"})
    rc = _cells(r, b, size).withColumnsRenamed({"__x0": "__rx", "__y0": "__ry"})
    meet = boxes.inner(a, b) if inner_only else boxes.intersects(a, b)
    j = lc.join(rc if few else rc.hint(MERGE), ["__cx", "__cy"]).where((F.col("__cx") == F.greatest("__lx", "__rx")) & (F.col("__cy") == F.greatest("__ly", "__ry")) & meet)
    if on is not None:
        j = j.where(on)
    return j.select(*l.columns, *r.columns)


def extent_join(assets: DataFrame, extents: DataFrame, size: float, prefix: str = "r_") -> DataFrame:
    """Assets with each raster whose extent they meet."""
    return box_join(assets, extents, size, left_prefix="", right_prefix=prefix, few=True)


#: Cells of a nearest join, as powers of two of its finest, which are 1 / 64 of the radius.
SHIFTS = (6, 4, 2, 0)
#: More points than these in one of the finest cells, and of those at one place only the first k stay.
HOT = 4096
#: A place without a coordinate, or with one that is no finite number, is near nothing.
REAL = "px - px = 0 and py - py = 0"


def reached(targets: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """The targets (tx, ty) that have one of the cells (__cx, __cy, of that edge) as theirs or beside it. The cells are spread, not the targets."""
    near = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)).alias(c)
    cell = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("bigint")
    wide = cells.select("__cx", "__cy").distinct().select(near("__cx"), "__cy").select("__cx", near("__cy")).distinct()
    return targets.withColumns({"__cx": cell("tx"), "__cy": cell("ty")}).join(wide.hint(MERGE), ["__cx", "__cy"], "left_semi").drop("__cx", "__cy")


def radius_join(points: DataFrame, targets: DataFrame, radius: float, point_id: str, target_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """target, point, d2: pairs at most radius apart. Both have x, y in plane units; cells are as wide as the radius. keep: further columns of the targets."""
    p = points.select(F.col(point_id), F.col("x").alias("px"), F.col("y").alias("py"))
    t = targets.select(F.col(target_id), F.col("x").alias("tx"), F.col("y").alias("ty"), *keep)
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("bigint")
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    pc = p.where(REAL).withColumn("__cx", cell("px")).withColumn("__cy", cell("py"))
    tc = reached(t, pc, radius).withColumn("__cx", near("tx")).withColumn("__cy", near("ty"))
    j = pc.join(tc.hint(MERGE), ["__cx", "__cy"]).select(*t.columns, *p.columns)
    return j.withColumn("d2", _d2()).where(F.col("d2") <= radius * radius)


def _d2() -> Column:
    return (F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2


def first_at_place(points: DataFrame, point_id: str) -> DataFrame:
    """Of the points at one place (x, y) the one of smallest id. Enough wherever all depends on the place and ties go by the id."""
    return points.groupBy("x", "y").agg(F.min(point_id).alias(point_id))


def nearest(points: DataFrame, targets: DataFrame, radius: float, k: int, point_id: str, target_id: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each target the k nearest points within the radius, rank from 1; ties by the point's id. Without a match a target has no row.

    How many points a target meets goes by k and not by how dense they are. Fine cells are counted, and written with the bounds of their points. A target's own cell, at the finest level that has k points in it, gives a first
    distance within which k points surely are; the fine cells within that, by their furthest corners, a closer one. Only points of fine cells that begin within it are compared."""
    size = radius / 2 ** max(SHIFTS)
    fine = lambda c: F.floor(F.col(c) / F.lit(float(size))).cast("bigint")
    p = points.select(F.col(point_id), F.col("x").alias("px"), F.col("y").alias("py")).where(REAL).withColumns({"__cx": fine("px"), "__cy": fine("py")})
    t = targets.select(F.col(target_id), F.col("x").alias("tx"), F.col("y").alias("ty"), *keep)
    ends = lambda n: [F.min("px").alias("__px0"), F.max("px").alias("__px1"), F.min("py").alias("__py0"), F.max("py").alias("__py1"), n.alias("__n")]
    cells = cut(p.groupBy("__cx", "__cy").agg(*ends(F.count(F.lit(1)))))
    # the squared distances of the nearest and furthest place that a cell's bounds allow
    off = lambda c: F.greatest(F.col(f"__p{c}0") - F.col(f"t{c}"), F.col(f"t{c}") - F.col(f"__p{c}1"), F.lit(0))
    span = lambda c: F.greatest(F.abs(F.col(f"__p{c}0") - F.col(f"t{c}")), F.abs(F.col(f"__p{c}1") - F.col(f"t{c}")))
    low, high = off("x") ** 2 + off("y") ** 2, span("x") ** 2 + span("y") ** 2
    above = lambda c: F.expr(f"shiftright({c}, __s)")
    levels = F.explode(F.array(*map(F.lit, SHIFTS)))

    pyramid = cells.withColumn("__s", levels).withColumns({"__ax": above("__cx"), "__ay": above("__cy")})
    renamed = pyramid.withColumnsRenamed({"__px0": "px", "__py0": "py"})
    full = renamed.groupBy("__s", "__ax", "__ay").agg(F.min("px").alias("__px0"), F.max("__px1").alias("__px1"), F.min("py").alias("__py0"), F.max("__py1").alias("__py1"), F.sum("__n").alias("__n")).where(F.col("__n") >= k)
    t = reached(t, cells.select(*(F.expr(f"shiftright({c}, {max(SHIFTS)})").alias(c) for c in ("__cx", "__cy"))), radius)
    own = t.select(target_id, "tx", "ty", levels.alias("__s"), fine("tx").alias("__cx"), fine("ty").alias("__cy")).withColumns({"__ax": above("__cx"), "__ay": above("__cy")})
    first = own.join(full.hint(MERGE), ["__s", "__ax", "__ay"]).groupBy(target_id).agg(F.min(high).alias("__high"))
    r2 = F.least(F.coalesce("__high", F.lit(float(radius * radius))), F.lit(float(radius * radius)))
    asked = t.join(first.hint(MERGE), target_id, "left").withColumn("__r2", r2).withColumn("__r", F.sqrt("__r2") * (1 + 1e-9)).drop("__high")
    level = F.lit(max(SHIFTS))
    for s in sorted(SHIFTS, reverse=True)[1:]:
        level = F.when(F.col("__r") <= size * 2**s, s).otherwise(level)
    over = lambda c: F.explode(F.sequence(*(F.expr(f"shiftright(cast(floor(({c} {o} __r) / {size!r}D) as bigint), __s)") for o in "-+")))
    asked = asked.withColumn("__s", level).withColumn("__ax", over("tx")).withColumn("__ay", over("ty"))
    near = asked.join(pyramid.hint(MERGE), ["__s", "__ax", "__ay"]).withColumns({"__low": low, "__high": high}).where("__low <= __r2")
    w = Window.partitionBy(target_id)
    near = near.withColumn("__sum", F.sum("__n").over(w.orderBy("__high"))).withColumn("__enough", F.min(F.when(F.col("__sum") >= k, F.col("__high"))).over(w))
    near = near.where(F.col("__low") <= F.least("__r2", F.coalesce("__enough", "__r2"))).select(*t.columns, "__cx", "__cy")

    hot = F.broadcast(cells.where(F.col("__n") > HOT).select("__cx", "__cy"))
    if not hot.isEmpty():
        place = Window.partitionBy("px", "py").orderBy(point_id)
        some = p.join(hot, ["__cx", "__cy"], "left_semi").withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= k).drop("__n")
        p = p.join(hot, ["__cx", "__cy"], "left_anti").unionByName(some)
    pairs = p.join(near.hint(MERGE), ["__cx", "__cy"]).select(*t.columns, point_id, "px", "py").withColumn("d2", _d2()).where(F.col("d2") <= radius * radius)
    return pairs.withColumn("rank", F.row_number().over(w.orderBy("d2", point_id))).where(F.col("rank") <= k)


def camera_join(assets: DataFrame, cameras: DataFrame, metres: float = 60.0, most: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, event_id, x, y, dist, px, py, tx, ty: of each asset its cameras within that many metres, the nearest `most` by degrees among those within twice the radius. x, y: metres east and north of the asset; px, py and tx, ty: the camera's and the asset's place. assets: id, lon, lat; cameras: event_id, plon, plat. keep: further columns of the assets."""
    degrees = 2 * metres / geo.METRES_PER_DEGREE
    targets = assets.select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), *keep)
    near = nearest(cameras.select("event_id", F.col("plon").alias("x"), F.col("plat").alias("y")), targets, degrees, most, "event_id", "id", keep).where(F.col("d2") < degrees * degrees)
    x, y = geo.local_xy(F.col("px"), F.col("py"), F.col("tx"), F.col("ty"))
    return near.select("id", "event_id", x.alias("x"), y.alias("y"), "px", "py", "tx", "ty", *keep).withColumn("dist", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).where(F.col("dist") <= metres)


def neighbours(assets: DataFrame, metres: float, size: float, unit_m: float = 0.111111) -> DataFrame:
    """l_id, r_id and boxes of assets whose boxes meet another's box grown by that many metres; the asset itself isn't its neighbour. unit_m: metres of a coordinate unit."""
    grown = assets.select("id", *(c.alias(n) for n, c in zip(Box._fields, boxes.buffer(boxes.box(), metres / unit_m))))
    return box_join(grown, assets.select("id", *Box._fields), size).where("l_id <> r_id")


def blocked_views(pairs: DataFrame, blockers: DataFrame, size: float) -> DataFrame:
    """id, event_id of those pairs (id, event_id, cx, cy: the asset's middle; px, py: the camera; own box) whose line of sight another asset's box cuts by more than a point. A camera inside its asset is never blocked."""
    own = boxes.Box(*(F.col(f"own_{c}") for c in Box._fields))
    outside = pairs.where(~((F.col("px") > own.minx) & (F.col("px") < own.maxx) & (F.col("py") > own.miny) & (F.col("py") < own.maxy)))
    lines = outside.select("id", "event_id", "cx", "cy", "px", "py", F.least("cx", "px").alias("minx"), F.least("cy", "py").alias("miny"), F.greatest("cx", "px").alias("maxx"), F.greatest("cy", "py").alias("maxy"))
    hit = box_join(lines, blockers.select("id", *Box._fields), size, on=F.col("l_id") != F.col("r_id"))
    share = boxes.sight_overlap(F.col("l_px"), F.col("l_py"), F.col("l_cx"), F.col("l_cy"), boxes.box("r_"))
    return hit.where(share > 1e-9).select(F.col("l_id").alias("id"), F.col("l_event_id").alias("event_id")).distinct()


def clear_views(pairs: DataFrame, blockers: DataFrame, size: float) -> DataFrame:
    """The pairs that blocked_views doesn't give."""
    return pairs.join(blocked_views(pairs, blockers, size), ["id", "event_id"], "left_anti")


RAYS = ((0, "major_pos"), (90, "minor_pos"), (180, "major_neg"), (270, "minor_neg"))


def ray_name(angle: Column) -> Column:
    out = F.concat(F.lit("ray_"), angle.cast("int").cast("string"))
    for a, n in RAYS:
        out = F.when(F.pmod(angle.cast("double"), F.lit(360.0)) == a, n).otherwise(out)
    return out


def rays(corners: Column | None = None, interval: int | None = None) -> Column:
    """Array of struct<angle, axis>: the four faces, and rays to the corners (array of struct<x, y> in the asset's rotated metres; corner_1 is the one of smallest angle) or every `interval` degrees. A corner on a face's ray is that face."""
    faces = F.array(*(F.struct(F.lit(float(a)).alias("angle"), F.lit(n).alias("axis")) for a, n in RAYS))
    if corners is None and interval is None:
        return faces
    if corners is None:
        others = F.array(*(F.struct(F.lit(float(a)).alias("angle"), F.lit(f"ray_{a}").alias("axis")) for a in range(0, 360, interval) if a % 90))
        return F.concat(faces, others.cast("array<struct<angle:double,axis:string>>"))
    angle = F.array_sort(F.transform(corners, lambda c: F.pmod(F.degrees(F.atan2(c["y"], c["x"])), F.lit(360.0))))
    named = F.transform(angle, lambda a, i: F.struct(a.alias("angle"), F.concat(F.lit("corner_"), (i + 1).cast("string")).alias("axis")))
    off = lambda r: F.abs(r["angle"] / 90.0 - F.round(r["angle"] / 90.0)) > 1e-7
    return F.concat(faces, F.filter(named, off))


def match_rays(cands: DataFrame, angles: list[int] = [a for a, _ in RAYS], tolerance: float = 10.0) -> DataFrame:  # noqa: B006
    """cands (id, event_id, x, y in the asset's rotated metres) with each ray (angle from the major axis) that they stand on: perp is their distance from the ray. A column `rays` (see rays) takes the place of the angles, and gives angle and axis."""
    if "rays" in cands.columns:
        j = cands.withColumn("__r", F.explode("rays")).withColumns({"angle": F.col("__r.angle"), "axis": F.col("__r.axis")}).drop("rays", "__r")
    else:
        j = cands.withColumn("angle", F.explode(F.array(*map(F.lit, angles))))
    c, s = F.cos(F.radians(F.col("angle").cast("double"))), F.sin(F.radians(F.col("angle").cast("double")))
    j = j.withColumn("perp", F.abs(-F.col("x") * s + F.col("y") * c)).withColumn("along", F.col("x") * c + F.col("y") * s)
    return j.where((F.col("perp") <= tolerance) & (F.col("along") > 0))


def _nearest_to_ray(matched: DataFrame, *keys: str) -> DataFrame:
    """keys, event_id: the camera of least perp, to 6 digits, ties by id. Perp and a whole-numbered id go into one number, whose least needs a place a key; a struct's least would have all rows sorted first."""
    perp = F.round("perp", 6)
    if matched.schema["event_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        return matched.groupBy(*keys).agg(F.min_by("event_id", F.struct(perp, "event_id")).alias("event_id"))
    whole, low = "decimal(38,0)", 2**63
    packed = F.round(perp * 1e6).cast("decimal(17,0)") * F.lit(Decimal(10**20)) + (F.col("event_id").cast("decimal(20,0)") + F.lit(Decimal(low)))
    best = matched.groupBy(*keys).agg(F.min(packed.cast(whole)).alias("__best"))
    return best.select(*keys, (F.col("__best") % F.lit(Decimal(10**20)) - F.lit(Decimal(low))).cast(matched.schema["event_id"].dataType).alias("event_id"))


def best_by_named_ray(matched: DataFrame) -> DataFrame:
    """id, angle, axis, event_id: of each asset and ray that has a camera the one nearest to the ray (ties by id)."""
    return _nearest_to_ray(matched, "id", "angle", "axis")


def localise(matched: DataFrame, assets: DataFrame, size: float) -> DataFrame:
    """matched (from match_rays, with tx, ty: the asset's middle, px, py: the camera, own_minx .. own_maxy: its box) without the cameras whose view of their asset another of the assets blocks. matched is written once; what follows reads that."""
    m = cut(matched)
    pairs = m.select("id", "event_id", F.col("tx").alias("cx"), F.col("ty").alias("cy"), "px", "py", *(f"own_{c}" for c in Box._fields)).dropDuplicates(["id", "event_id"])
    return m.join(blocked_views(pairs, assets, size), ["id", "event_id"], "left_anti")


def best_by_ray(matched: DataFrame, assets: DataFrame | None = None, angles: list[int] = [a for a, _ in RAYS]) -> DataFrame:  # noqa: B006
    """id, angle, event_id: of each asset and ray the camera nearest to the ray (ties by id), null where there is none. Without assets only the rays that have one."""
    best = _nearest_to_ray(matched, "id", "angle")
    if assets is None:
        return best
    rays = assets.select("id", F.explode(F.array(*map(F.lit, angles))).alias("angle"))
    return rays.join(best.hint(MERGE), ["id", "angle"], "left")


def ray_order(name: Column) -> Column:
    """A sort key of ray names: the faces clockwise from the major axis, corners by number, other rays by angle."""
    n = F.coalesce(F.regexp_extract(name, r"_([0-9]+)", 1).try_cast("int"), F.lit(0))
    face = F.lit(None).cast("int")
    for k, (_, f) in enumerate(RAYS):
        face = F.when(name.contains(f), k).otherwise(face)
    return F.struct(F.coalesce(face, F.when(name.contains("corner"), 4).otherwise(5)), F.when(face.isNotNull(), 0).otherwise(n))


def capped(best: DataFrame, most: int = 8) -> DataFrame:
    """Of each asset the first `most` rays that have a camera: major, then minor, then other rays, each by angle; `place` from 1."""
    name = F.col("axis") if "axis" in best.columns else ray_name(F.col("angle"))
    prio = F.when(name.startswith("major"), 0).when(name.startswith("minor"), 1).otherwise(2)
    w = Window.partitionBy("id").orderBy(prio, "angle")
    return best.where("event_id is not null").withColumn("axis", name).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def circular_gap(df: DataFrame, key: str, angle: str) -> DataFrame:
    """key, gap, after: the largest gap between neighbouring bearings around the circle, and the bearing that it follows. One bearing has a gap of 360."""
    w = Window.partitionBy(key).orderBy(angle)
    first = F.first(angle).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    nxt = F.coalesce(F.lead(angle).over(w), first + 360)
    return df.select(key, angle).distinct().withColumn("__g", nxt - F.col(angle)).groupBy(key).agg(F.max("__g").alias("gap"), F.min_by(angle, F.struct(-F.col("__g"), F.col(angle))).alias("after"))


def seed_match(masks: DataFrame, seeds: DataFrame, on: list[str], least_iou: float = 0.15, least_recall: float = 0.5) -> DataFrame:
    """Masks with the seed of the same keys that they cover: intersection over union, or share of the seed covered."""
    m = masks.select(*on, *(F.col(c) for c in masks.columns if c not in on))
    s = seeds.select(*on, *(F.col(c).alias(f"s_{c}") for c in seeds.columns if c not in on))
    a, b = boxes.box(), boxes.box("s_")
    i = boxes.overlap_area(a, b)
    j = m.join(s, on).withColumn("iou", i / (boxes.area(a) + boxes.area(b) - i)).withColumn("recall", i / boxes.area(b))
    return j.where((F.col("iou") >= least_iou) | (F.col("recall") >= least_recall))
