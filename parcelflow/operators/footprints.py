"""Footprints and roads: geometry kernels by group. Groups (components of overlapping shapes, or one asset) are independent, so they spread over the cluster; a kernel sees one group."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.functions import boxes
from parcelflow.kernels import batch as B
from parcelflow.kernels import mask as M
from parcelflow.kernels import polygon as P
from parcelflow.kernels import road as R
from parcelflow.operators import graph, keyed, spatial
from parcelflow.session import spread, tasks

RINGS = "array<array<struct<x:double,y:double>>>"


def region(rings) -> P.Region:
    """A kernel's region of a RINGS value."""
    return [P.ring([(p["x"], p["y"]) for p in r]) for r in rings] if rings is not None else []


def rings(g: P.Region) -> list:
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in g]


def with_bounds(df: DataFrame) -> DataFrame:
    """df with minx .. maxy of its rings."""
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    return df.withColumns({"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)})


def _record(columns: dict):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def mapped(df: DataFrame, work: Callable, schema) -> DataFrame:
    """What work makes of each Arrow batch of df, as columns in the order of schema. df is spread over the cluster first, however few files it comes in."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            if batch.num_rows:
                got = work(batch)
                yield got if isinstance(got, pa.RecordBatch) else _record(got)

    return spread(df).mapInArrow(run, schema)


def _rings_of(batch, name: str = "rings") -> B.Batch:
    return B.from_arrow(batch.column(batch.schema.get_field_index(name)))


def _with_rings(batch, g: B.Batch):
    return batch.set_column(batch.schema.get_field_index("rings"), "rings", B.to_arrow(g))


def sound(df: DataFrame, least: float = 1e-9) -> DataFrame:
    """Rows whose rings are a polygon with area that doesn't collapse."""
    import pyarrow as pa

    return mapped(df, lambda batch: batch.filter(pa.array(B.sound(_rings_of(batch), least))), df.schema)


def measure(df: DataFrame, key: str = "id") -> DataFrame:
    """key, area, perimeter, cx, cy, major, minor: area without holes, centroid of the largest part, headings of the smallest rectangle's sides."""

    def work(batch):
        g = _rings_of(batch)
        p, owner = B.parts(g)
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        if first.sum() != len(g):
            raise ValueError("a row without rings can't be measured")
        c = B.centroids(p)[p.region[:-1][first]]
        major, minor = B.principal_axes(g)
        return {key: batch.column(0), "area": B.areas(g), "perimeter": B.perimeters(g), "cx": np.ascontiguousarray(c[:, 0]), "cy": np.ascontiguousarray(c[:, 1]), "major": major, "minor": minor}

    return mapped(df.select(key, "rings"), work, f"{key} {dict(df.dtypes)[key]}, area double, perimeter double, cx double, cy double, major double, minor double")


def part_counts(df: DataFrame, key: str = "id") -> DataFrame:
    """key, parts: how many connected parts each row has."""
    return mapped(df.select(key, "rings"), lambda batch: {key: batch.column(0), "parts": np.bincount(B.parts(_rings_of(batch))[1], minlength=batch.num_rows)}, f"{key} {dict(df.dtypes)[key]}, parts bigint")


def filter_by_polygon(df: DataFrame, search: list[tuple[float, float]], predicate: str = "intersects") -> DataFrame:
    """Rows whose polygon stands so to the search polygon. Boxes decide first where they can."""
    if predicate not in boxes.PREDICATES:
        raise ValueError(f"Unsupported predicate {predicate!r}")
    g = [P.ring(search)]
    lo, hi = g[0].min(0), g[0].max(0)
    x = with_bounds(df)
    if predicate != "disjoint":
        x = x.where(boxes.intersects(boxes.box(), boxes.literal(*lo, *hi)))

    def run(it):
        for pdf in it:
            yield pdf[[P.relation(region(r), g)[predicate] for r in pdf["rings"]]]

    return x.select(*df.columns).mapInPandas(run, df.schema)


def shaped(df: DataFrame, work: Callable[[B.Batch], B.Batch]) -> DataFrame:
    """df with what a kernel makes of its rings."""
    return mapped(df, lambda batch: _with_rings(batch, work(_rings_of(batch))), df.schema)


def buffered(df: DataFrame, d: float) -> DataFrame:
    """rings grown (or shrunk) by d."""
    return shaped(df, lambda g: B.buffer(g, d))


def hulls(df: DataFrame) -> DataFrame:
    """rings as their convex hull; without area as they are."""
    return shaped(df, lambda b: B.of([[h] if len(h) > 2 else g for h, g in zip(B.hulls(b), b.regions())]))


def filled(df: DataFrame) -> DataFrame:
    """rings without holes."""
    return shaped(df, B.fill_holes)


def closed(df: DataFrame, d: float) -> DataFrame:
    """rings with gaps under 2 d bridged."""
    return shaped(df, lambda g: B.close_gaps(g, d))


def cut_by_walls(df: DataFrame, other: str = "other") -> DataFrame:
    """rings cut along the longest wall of the polygon in the column `other` that they touch; the rest of df stays."""
    return mapped(df, lambda batch: _with_rings(batch, B.wall_cut(_rings_of(batch), _rings_of(batch, other))), df.schema)


def overlap_edges(df: DataFrame, key: str, size: float, more_than: float = 0.5) -> DataFrame:
    """a, b: pairs of polygons whose common area is more than that share of the smaller one. Boxes meet by cells, kernels measure the candidates."""
    x = with_bounds(df.select(key, "rings"))
    j = spatial.box_join(x, x, size, on=F.col(f"l_{key}") < F.col(f"r_{key}"), inner_only=True).select(F.col(f"l_{key}").alias("a"), F.col(f"r_{key}").alias("b"), F.col("l_rings").alias("p"), F.col("r_rings").alias("q"))

    def work(batch):
        import pyarrow as pa

        g, h = _rings_of(batch, "p"), _rings_of(batch, "q")
        ok = B.areas(B.intersection(g, h)) > more_than * np.minimum(B.areas(g), B.areas(h))
        return batch.select(["a", "b"]).filter(pa.array(ok))

    t = dict(df.dtypes)[key]
    return mapped(j, work, f"a {t}, b {t}")


def _by_group(df: DataFrame, key: str, comp: DataFrame, work: Callable, schema: str) -> DataFrame:
    """What work makes of whole groups: of (group of each row, ids and roots as Arrow arrays, regions), rows by group and id. A task goes through its groups in sorted batches and holds those of one batch, or one group."""
    g = df.select(F.col(key).alias("id"), "rings").join(comp, "id").select("root", "id", "rings")

    def run(it):
        import pyarrow as pa
        import pyarrow.compute as pc

        def done(t):
            root = t.column("root")
            new = pc.not_equal(root[1:], root[:-1]).to_numpy(zero_copy_only=False)
            group = np.concatenate([[0], np.cumsum(new)])
            return _record(work(group, t.column("id"), root, B.from_arrow(t.column("rings"))))

        held: list = []
        for batch in it:
            if not batch.num_rows:
                continue
            root = batch.column(0)
            ends = np.flatnonzero(pc.not_equal(root[1:], root[:-1]).to_numpy(zero_copy_only=False))
            if held and root[0] != held[0].column(0)[0]:
                yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []
            if len(ends):
                at = int(ends[-1]) + 1
                yield done(pa.Table.from_batches([*held, batch.slice(0, at)]).combine_chunks().to_batches()[0])
                held, batch = [], batch.slice(at)
            held.append(batch)
        if held:
            yield done(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return g.repartition(tasks(df), "root").sortWithinPartitions("root", "id").mapInArrow(run, schema)


def _outlines(holes: bool):
    def work(group, ids, root, g):
        import pyarrow as pa

        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        p, owner = B.parts(B.united(g, group, len(first)))
        part = np.arange(len(owner)) - np.searchsorted(owner, owner)
        shape = p if holes else p.take_rings(p.region[:-1], np.arange(len(p)), len(p))
        return {"root": root.take(pa.array(first[owner])), "part": part.astype(np.int32), "n": np.bincount(group)[owner].astype(np.int32), "rings": B.to_arrow(shape)}

    return work


def dissolve(df: DataFrame, key: str, size: float, more_than: float = 0.5) -> DataFrame:
    """root, part, n, rings: each group of overlapping polygons as one outline without holes, by part. Attributes don't survive."""
    comp = graph.components(df.select(F.col(key).alias("id")), overlap_edges(df, key, size, more_than))
    return _by_group(df, key, comp, _outlines(False), f"root {dict(df.dtypes)[key]}, part int, n int, rings {RINGS}")


def unioned(df: DataFrame, key: str, size: float) -> DataFrame:
    """root, part, n, rings: polygons that meet as one, holes kept."""
    comp = graph.components(df.select(F.col(key).alias("id")), overlap_edges(df, key, size, 0.0))
    return _by_group(df, key, comp, _outlines(True), f"root {dict(df.dtypes)[key]}, part int, n int, rings {RINGS}")


def truncated(df: DataFrame, key: str, size: float) -> DataFrame:
    """id, rings: overlaps resolved, the larger polygon keeping its ground; what is left of nothing isn't there. Order matters only within a component, so components are worked on apart."""
    comp = graph.components(df.select(F.col(key).alias("id")), overlap_edges(df, key, size, 0.0))

    def work(group, ids, root, g):
        import pyarrow as pa

        out = B.clip_in_order(g, group)
        left = np.flatnonzero(np.diff(out.region))
        return {"id": ids.take(pa.array(left)), "rings": B.to_arrow(out.take(left))}

    return _by_group(df, key, comp, work, f"id {dict(df.dtypes)[key]}, rings {RINGS}")


def bridged(df: DataFrame, key: str, most: float = 15.0) -> DataFrame:
    """key, rings: each row's fragments joined over gaps up to twice half the largest gap of their spanning tree and a little, at most `most`."""

    def run(it):
        for pdf in it:
            out = []
            for k, r in pdf[[key, "rings"]].itertuples(index=False):
                ps = P.parts(region(r))
                gaps = sorted((P.distance(a, b), i, j) for i, a in enumerate(ps) for j, b in enumerate(ps) if i < j)
                root, worst = list(range(len(ps))), 0.0
                for d, i, j in gaps:
                    if root[i] != root[j]:
                        root = [root[i] if x == root[j] else x for x in root]
                        worst = d
                g = [q for p in ps for q in p]
                out.append((k, rings(P.close_gaps(g, min(worst / 2 * 1.05, most)) if worst else g)))
            yield pd.DataFrame(out, columns=[key, "rings"])

    return df.select(key, "rings").mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, rings {RINGS}")


def polygon_tiles(df: DataFrame, key: str, zoom: int) -> DataFrame:
    """key, x, y, z, area: tiles that a polygon in degrees covers in part, with the area in square degrees."""
    from parcelflow.functions import geo

    b = with_bounds(df.select(key, "rings"))
    t = b.select(key, "rings", F.explode(geo.cover_tiles(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), zoom)).alias("t")).select(key, "rings", "t.*")
    lon0, lat1 = geo.tile_to_wgs84(F.lit(0), F.lit(0), F.col("x"), F.col("y"), zoom)
    lon1, lat0 = geo.tile_to_wgs84(F.lit(0), F.lit(0), F.col("x") + 1, F.col("y") + 1, zoom)
    placed = t.select(key, "rings", "x", "y", "z", lon0.alias("a"), lat0.alias("b"), lon1.alias("c"), lat1.alias("d"))

    def work(batch):
        import pyarrow as pa

        at = lambda n: batch.column(batch.schema.get_field_index(n))
        a, b, c, d = (at(n).to_numpy(zero_copy_only=False) for n in "abcd")
        tile = np.stack([a, b, c, b, c, d, a, d], 1).reshape(-1, 2)
        n = len(a)
        g = B.intersection(_rings_of(batch), B.Batch(tile, np.arange(n + 1) * 4, np.arange(n + 1)))
        left = pa.array(np.flatnonzero(np.diff(g.region)))
        return {**{k: at(k).take(left) for k in (key, "x", "y", "z")}, "area": B.areas(g)[left.to_numpy()]}

    return mapped(placed, work, f"{key} {dict(df.dtypes)[key]}, x bigint, y bigint, z int, area double")


def mask_polygons(df: DataFrame, key: str = "id") -> DataFrame:
    """key, part, rings of mask rows (key, h, w, mask: bytes of 0 and 1, x0, y0, sx, sy)."""

    def work(batch):
        import pyarrow as pa

        rows = batch.to_pylist()
        got = [M.outlines(np.frombuffer(r["mask"], np.uint8).reshape(r["h"], r["w"]), (r["x0"], r["y0"], r["sx"], r["sy"])) for r in rows]
        n = np.array([len(g) for g in got])
        at = batch.column(batch.schema.get_field_index(key)).take(pa.array(np.repeat(np.arange(len(n)), n)))
        part = np.array([k for g in got for k in range(len(g))], np.int32)
        return {key: at, "part": part, "rings": B.to_arrow(B.of([g for m in got for g in m]))}

    return mapped(df, work, f"{key} {dict(df.dtypes)[key]}, part int, rings {RINGS}")


def regularise_buildings(detections: DataFrame, seeds: DataFrame, size: float, retry=None) -> DataFrame:
    """id, rings: detections (asset_id, did, rings) that match their asset's seed polygon, dissolved, truncated, sound ones only. retry(asset ids) gives detections for assets without a match, matched with lower thresholds."""
    on = ["asset_id"]
    s = with_bounds(seeds.select("asset_id", "rings")).select("asset_id", *boxes.Box._fields)
    good = spatial.seed_match(with_bounds(detections), s, on)
    if retry is not None:
        missed = keyed.remove(seeds.select("asset_id"), good.select("asset_id"), "asset_id")
        again = spatial.seed_match(with_bounds(retry(missed)), s, on, 0.3, 0.3)
        good = good.select("did", "rings").unionByName(again.select("did", "rings"))
    whole = graph.cut(dissolve(good.select("did", "rings"), "did", size))
    named = whole.select(F.concat_ws("_", F.lit("building"), F.col("root").cast("string"), F.col("part").cast("string")).alias("id"), "rings")
    return sound(truncated(named, "id", size))


def regularise_roads(surfaces: DataFrame, key: str = "id", least_area: float = 1000.0) -> tuple[DataFrame, DataFrame]:
    """Centrelines (key, n, line, width, azimuth, length) and their polygons (key, n, rings; wider roads keep their ground) of road surfaces in feet."""
    t = dict(surfaces.dtypes)[key]

    def lines(it):
        for pdf in it:
            out = []
            for k, r in pdf[[key, "rings"]].itertuples(index=False):
                for n, (x, w, a) in enumerate(R.regularise(region(r), least_area)):
                    out.append((k, n, [{"x": float(p[0]), "y": float(p[1])} for p in x], round(w, 2), round(a, 2), round(R.length(x), 2)))
            yield pd.DataFrame(out, columns=[key, "n", "line", "width", "azimuth", "length"])

    centre = surfaces.select(key, "rings").mapInPandas(lines, f"{key} {t}, n int, line array<struct<x:double,y:double>>, width double, azimuth double, length double")

    def strips(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: P.Region = []
        out = []
        for r in pdf.sort_values(["width", "n"], ascending=[False, True]).itertuples(index=False):
            x = np.array([(p["x"], p["y"]) for p in r.line])
            g = P.union(*(P.capsule(a, b, r.width / 2, flat=len(x) == 2) for a, b in zip(x, x[1:])))
            own = P.difference(g, taken) if taken else g
            taken = P.union(taken, g) if taken else g
            if own:
                out.append((getattr(r, key), r.n, rings(P.parts(own)[0])))
        return pd.DataFrame(out, columns=[key, "n", "rings"])

    return centre, centre.groupBy(key).applyInPandas(strips, f"{key} {t}, n int, rings {RINGS}")
