import math

import numpy as np
import pytest

from parcelflow.kernels import mask as M
from parcelflow.kernels import polygon as P
from parcelflow.kernels import road as R
from parcelflow.operators import footprints as FP


def box(x0, y0, x1, y1):
    return [P.ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]


A, B = box(0, 0, 10, 10), box(5, 5, 15, 15)


def test_boolean_areas():
    assert P.area(P.union(A, B)) == pytest.approx(175) and P.area(P.intersection(A, B)) == pytest.approx(25) and P.area(P.difference(A, B)) == pytest.approx(75)
    hole = P.difference(A, box(2, 2, 4, 4))
    assert P.area(hole) == pytest.approx(96) and len(hole) == 2 and P.area(P.fill_holes(hole)) == pytest.approx(100)
    assert P.area(P.union(A, box(10, 0, 20, 10))) == pytest.approx(200) and len(P.union(A, box(10, 0, 20, 10))) == 1
    assert P.intersection(A, box(20, 20, 30, 30)) == [] and P.area(P.union(A, A)) == pytest.approx(100) and len(P.parts(P.union(A, box(20, 0, 30, 5)))) == 2


@pytest.mark.parametrize("seed", range(12))
def test_area_identity_of_random_shapes(seed):
    r = np.random.default_rng(seed)

    def star():
        t = np.sort(r.uniform(0, 2 * np.pi, 9))
        return [np.stack([np.cos(t), np.sin(t)], 1) * r.uniform(0.4, 2, 9)[:, None] + r.uniform(-1, 1, 2)]

    a, b = star(), star()
    u, i, d, e = P.union(a, b), P.intersection(a, b), P.difference(a, b), P.difference(b, a)
    assert P.area(u) + P.area(i) == pytest.approx(P.area(a) + P.area(b), rel=1e-6)
    assert P.area(d) + P.area(e) + P.area(i) == pytest.approx(P.area(u), rel=1e-6)


def test_buffer():
    grown = P.buffer(A, 2)
    assert P.area(grown) == pytest.approx(100 + 4 * 20 + math.pi * 4, rel=0.01) and P.area(P.buffer(A, -2)) == pytest.approx(36) and P.buffer(A, -6) == []
    closed = P.close_gaps(A + box(11, 0, 20, 10), 1)
    assert len(P.parts(closed)) == 1 and P.area(closed) == pytest.approx(200, rel=0.02)


def test_relations_and_distance():
    r = P.relation
    assert r(A, B)["overlaps"] and r(box(2, 2, 3, 3), A)["within"] and r(A, box(2, 2, 3, 3))["contains"] and r(A, box(10, 0, 12, 5))["touches"] and r(A, box(11, 0, 12, 5))["disjoint"]
    assert P.distance(A, box(20, 0, 30, 10)) == pytest.approx(10) and P.distance(A, B) == 0 and P.distance(A, box(2, 2, 3, 3)) == 0


def test_rectangle_and_axes():
    t = math.radians(30)
    rot = np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]])
    pts = np.array([(0, 0), (8, 0), (8, 3), (0, 3)]) @ rot.T
    assert abs(P.signed_area(P.rotated_rectangle(pts))) == pytest.approx(24)
    major, minor = P.principal_axes(pts)
    assert major % 180 == pytest.approx(60) and minor % 180 == pytest.approx(150)
    assert not P.is_sound([np.array([(0, 0), (1, 1), (2, 2)])]) and P.is_sound(A)


def test_clipping_in_order():
    out = P.clip_in_order([box(8, 2, 14, 6), A, box(30, 0, 31, 1)])
    assert P.area(out[1]) == pytest.approx(100) and P.area(out[0]) == pytest.approx(16) and P.area(P.intersection(out[0], out[1])) < 1e-6 and P.area(out[2]) == pytest.approx(1)


def test_masks():
    m = np.zeros((20, 30), np.uint8)
    m[2:8, 3:9] = 1
    m[4:6, 5:7] = 0
    m[8:12, 9:15] = 1  # meets the first in a corner only
    lab, n = M.label(m > 0)
    assert n == 2 and (lab > 0).sum() == m.sum()
    shapes = M.outlines(m)
    assert sorted(P.area(s) for s in shapes) == [24, 32] and sorted(map(len, shapes)) == [1, 2]
    assert (M.fill([r for s in shapes for r in s], m.shape) == (m > 0)).all()
    assert sum(P.area(s) for s in M.outlines(m, (0.0, 20.0, 0.5, -0.5))) == pytest.approx(56 / 4)
    u = np.random.default_rng(1).random((30, 30)) < 0.5
    lab, n = M.label(u)
    assert len(set(lab[u].tolist())) == n and all((lab[y, x] == lab[y, x + 1]) for y in range(30) for x in range(29) if u[y, x] and u[y, x + 1])
    assert M.paint((10, 10), [(1, box(0, 0, 5, 5)), (300, box(3, 3, 8, 8))]).dtype == np.int32


def test_roads():
    straight = R.regularise(box(0, 0, 40, 800))
    assert len(straight) == 1
    line, width, azimuth = straight[0]
    assert width == pytest.approx(40, abs=2) and min(azimuth % 180, 180 - azimuth % 180) < 3 and R.length(line) > 600
    cross = P.union(box(0, 380, 800, 420), box(380, 0, 420, 800))
    got = R.regularise(cross)
    assert 2 <= len(got) <= 4 and sum(R.length(x) for x, *_ in got) > 1300
    assert R.regularise(box(0, 0, 10, 10)) == []
    a, b = np.array([(0.0, 0), (50, 0)]), np.array([(50.0, 0), (100, 5)])
    assert len(R.merge_collinear([a, b])) == 1 and len(R.merge_collinear([a, np.array([(50.0, 0), (50, 60)])])) == 2
    assert len(R.heal([a, b, np.array([(50.0, 0), (50, 4)])], 10)) == 1
    assert R.approx_width(box(0, 0, 30, 3000)) == pytest.approx(29.7, abs=0.1) and R.long_networks([a]) == []


RINGED = f"id string, rings {FP.RINGS}"


def rows(spark, named):
    return spark.createDataFrame([(k, FP.rings(g)) for k, g in named.items()], RINGED)


def test_dissolve_and_truncate(spark):
    df = rows(spark, {"a": A, "b": box(1, 1, 11, 11), "c": box(50, 50, 60, 60), "d": box(9, 0, 13, 3), "e": box(100, 0, 101, 1)})
    got = {r["root"]: r for r in FP.dissolve(df, "id", 20).collect()}
    assert set(got) == {"a", "c", "d", "e"} and got["a"]["n"] == 2 and P.area(FP.region(got["a"]["rings"])) == pytest.approx(119)
    cut = {r["id"]: P.area(FP.region(r["rings"])) for r in FP.truncated(rows(spark, {"a": A, "b": box(8, 2, 14, 6), "z": box(99, 0, 100, 1)}), "id", 20).collect()}
    assert cut == {"a": pytest.approx(100), "b": pytest.approx(16), "z": pytest.approx(1)}
    assert FP.sound(rows(spark, {"ok": A, "flat": [np.array([(0, 0), (1, 1), (2, 2)])]})).count() == 1
    m = {r["id"]: r for r in FP.measure(df).collect()}
    assert m["c"]["cx"] == pytest.approx(55) and m["c"]["perimeter"] == pytest.approx(40)
    inside = FP.filter_by_polygon(df, [(0, 0), (20, 0), (20, 20), (0, 20)], "within").collect()
    assert sorted(r["id"] for r in inside) == ["a", "b", "d"] and FP.buffered(df.where("id = 'c'"), 1).count() == 1
    u = FP.unioned(df, "id", 20)
    assert {r["root"] for r in u.collect()} == {"a", "c", "e"}
    b = FP.bridged(rows(spark, {"g": A + box(11, 0, 20, 10)}), "id").first()
    assert len(P.parts(FP.region(b["rings"]))) == 1


def test_buildings_and_roads(spark):
    from pyspark.sql import functions as F

    seeds = spark.createDataFrame([("s1", FP.rings(A)), ("s2", FP.rings(box(40, 0, 50, 10))), ("s3", FP.rings(box(80, 0, 90, 10)))], f"asset_id string, rings {FP.RINGS}")
    det = spark.createDataFrame([("s1", 1, FP.rings(box(0, 0, 9, 10))), ("s1", 2, FP.rings(box(1, 0, 10, 10))), ("s3", 3, FP.rings(box(200, 0, 201, 1)))], f"asset_id string, did bigint, rings {FP.RINGS}")
    retry = lambda missed: missed.where("asset_id = 's2'").select("asset_id", F.lit(9).cast("bigint").alias("did"), F.lit(None).cast(FP.RINGS).alias("rings")).drop("rings").join(seeds, "asset_id").select("asset_id", "did", "rings")
    got = {r["id"]: P.area(FP.region(r["rings"])) for r in FP.regularise_buildings(det, seeds, 30, retry).collect()}
    assert got == {"building_1_0": pytest.approx(100), "building_9_0": pytest.approx(100)}
    centre, polys = FP.regularise_roads(rows(spark, {"r": box(0, 0, 800, 40)}))
    c = centre.first()
    assert c["width"] == pytest.approx(40, abs=2) and polys.count() == centre.count()
    m = np.zeros((6, 8), np.uint8)
    m[1:3, 1:4] = 1
    df = spark.createDataFrame([("m", 6, 8, bytearray(m.tobytes()), 0.0, 0.0, 1.0, 1.0)], "id string, h int, w int, mask binary, x0 double, y0 double, sx double, sy double")
    assert P.area(FP.region(FP.mask_polygons(df).first()["rings"])) == pytest.approx(6)


def test_polygon_tiles(spark):
    from pyspark.sql import functions as F

    df = rows(spark, {"t": [P.ring([(-118.16, 34.18), (-118.14, 34.18), (-118.15, 34.2)])]})
    got = FP.polygon_tiles(df, "id", 15)
    assert got.agg(F.sum("area")).first()[0] == pytest.approx(0.02 * 0.02 / 2, rel=1e-6) and got.count() >= 4


def test_ray_names_sort(spark):
    from pyspark.sql import functions as F

    from parcelflow.operators import spatial

    names = ["ray_45", "corner_2", "minor_neg", "major_pos", "corner_10", "ray_7", "minor_pos", "major_neg"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(spatial.ray_order(F.col("n")))
    assert [r["n"] for r in df.collect()] == ["major_pos", "minor_pos", "major_neg", "minor_neg", "corner_2", "corner_10", "ray_7", "ray_45"]
