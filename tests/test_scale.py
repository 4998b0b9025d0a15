"""Work that grows with the input and no faster: few pairs, spread tasks, kernels over whole batches."""

import random

from pyspark.sql import functions as F

from parcelflow.operators import graph


def test_bottleneck_of_a_line_takes_neighbours_only(spark, monkeypatch):
    at = random.Random(3).sample(range(10**6), 3000)
    nodes = spark.createDataFrame([(k % 2, k) for k in at], "group int, k bigint")
    e = graph.line_edges(nodes, "k")
    assert e.count() == 2998  # of all pairs it would be over two million
    want = {g: max(b - a for a, b in zip(x, x[1:])) for g in (0, 1) for x in [sorted(k for k in at if k % 2 == g)]}
    ids = nodes.select("group", F.col("k").alias("id"))
    assert {r["group"]: r["gap"] for r in graph.bottleneck(e, ids).collect()} == want
    few = nodes.orderBy("k").limit(120)
    pairs = few.join(few.select("group", F.col("k").alias("b")), "group").where("k < b").select("group", F.col("k").alias("a"), "b", (F.col("b") - F.col("k")).cast("double").alias("w"))
    of_all, of_line = (graph.bottleneck(x, few.select("group", F.col("k").alias("id"))).orderBy("group").collect() for x in (pairs, graph.line_edges(few, "k")))
    assert of_all == of_line


def test_forest_keeps_a_trees_edges():
    import pandas as pd

    e = pd.DataFrame([(0, a, b, float((a * 7 + b * 3) % 11)) for a in range(20) for b in range(a + 1, 20)], columns=["group", "a", "b", "w"])
    parts = pd.concat([graph._forest(e.iloc[::2]), graph._forest(e.iloc[1::2])])
    assert len(parts) == 38 and graph._forest(parts)["w"].max() == graph._forest(e)["w"].max()


def test_models_get_rows_from_all_tasks(spark):
    from parcelflow.models import base

    df = spark.range(0, 500, 1, 1).select(F.col("id"), F.array(F.col("id").cast("string")).alias("paths"))
    got = base.infer(df, lambda: base.BatchBackend(lambda r: [base.ModelOutput(i[0], boxes=[[len(r)]]) for i, _ in r]), "p", batch=4)
    assert got.rdd.getNumPartitions() > 4
    assert sorted((r["id"], r["text"]) for r in got.collect()) == [(k, str(k)) for k in range(500)]
    assert got.where(F.get_json_object("boxes", "$[0][0]").cast("int") > 4).isEmpty()


def test_kernels_of_batches_agree_with_those_of_one():
    import numpy as np
    import pytest

    from parcelflow.kernels import batch as B
    from parcelflow.kernels import polygon as P

    r = np.random.default_rng(4)

    def star(n):
        t = np.sort(r.uniform(0, 2 * np.pi, n))
        return np.stack([np.cos(t), np.sin(t)], 1) * r.uniform(0.4, 2, n)[:, None] + r.uniform(-1, 1, 2)

    square = lambda a, b: np.array([(a, a), (b, a), (b, b), (a, b)], float)
    g = [[star(k % 6 + 4)] for k in range(40)] + [[square(0, 9), square(1, 8), square(2, 7)], [square(0, 4), square(4, 8)], [square(0, 4), square(9, 10)], []]
    h = [[star(7)] for _ in g]
    b, c = B.of(g), B.of(h)
    assert B.areas(b) == pytest.approx([P.area(x) for x in g])
    assert B.areas(B.intersection(b, c)) == pytest.approx([P.area(P.intersection(x, y)) for x, y in zip(g, h)])
    assert B.areas(B.difference(b, c)) == pytest.approx([P.area(P.difference(x, y)) for x, y in zip(g, h)])
    assert B.areas(B.wall_cut(b, c)) == pytest.approx([P.area(P.wall_cut(x, y)) for x, y in zip(g, h)])
    assert [len(x) for x in B.fill_holes(b).regions()] == [len(P.fill_holes(x)) for x in g]
    group = np.arange(len(g)) // 3
    clipped = [x for k in range(group[-1] + 1) for x in P.clip_in_order([y for y, q in zip(g, group) if q == k])]
    assert B.areas(B.clip_in_order(b, group)) == pytest.approx([P.area(x) for x in clipped])

    def belt(x, d):  # by the union of the edges' capsules
        caps = [P.capsule(p, q, abs(d)) for p, q in P._edges(x)]
        return P.union(x, *caps) if d > 0 else P.combine([x, *caps], lambda m: m[0] & ~np.logical_or.reduce(m[1:]))

    few = g[:4] + g[-4:-1]
    for d in (0.3, -0.2, -2.5):
        assert B.areas(B.buffer(B.of(few), d)) == pytest.approx([P.area(belt(x, d)) for x in few], abs=2e-3, rel=1e-3)


def test_corners_far_from_the_origin_stay():
    import numpy as np

    from parcelflow.kernels import polygon as P

    far = np.array([(9e8, 3e7), (9e8 + 150, 3e7), (9e8 + 150, 3e7 + 140), (9e8, 3e7 + 140)])
    assert len(P.ring(far)) == 4 and len(P.ring([*far, far[0]])) == 4 and P.centroid(P.ring(far)) == (9e8 + 75, 3e7 + 70)


def test_footprints_are_spread(spark):
    from parcelflow.operators import footprints

    df = spark.range(0, 100, 1, 1).selectExpr("id", "array(array(struct(0D as x, 0D as y), struct(1D as x, 0D as y), struct(1D as x, 1D as y))) as rings")
    assert footprints.buffered(df, 1.0).rdd.getNumPartitions() > 4 and footprints.measure(footprints.filled(df)).count() == 100


def test_files_and_features_are_spread(spark):
    from parcelflow.sources import geojson, pictures

    df = spark.range(0, 100, 1, 1)
    point = "struct('Point' as type, array(array(array(struct(1D as x, 2D as y)))) as parts)"
    a = df.selectExpr("cast(id as string) as id", "id as ord", f"{point} as geom", "map('a', cast(1 as variant)) as attrs")
    assert geojson.features(a).rdd.getNumPartitions() > 4
    assert pictures.save_files(df.selectExpr("cast(id as string) as path", "cast('x' as binary) as content")).rdd.getNumPartitions() > 4


def joined(df):
    """df's rows, the most rows that a join of its plan gave, and whether it broadcast any."""
    got = df.collect()
    rows, names = [0], []

    def walk(p):
        name = p.nodeName()
        names.append(name)
        if "Join" in name:
            rows.append(p.metrics().apply("numOutputRows").value())
        inner = [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        below = p.children()
        for q in [*inner, *(below.apply(k) for k in range(below.size()))]:
            walk(q)

    walk(df._jdf.queryExecution().executedPlan())
    return got, max(rows), any("Broadcast" in n for n in names)


def dense(spark, n=20000):
    """Cameras packed in a square of which a few assets lie on, and others far off."""
    points = spark.range(n).selectExpr("id as event_id", "(id * 7919) % 1009 as x", "(id * 104729) % 997 as y")
    targets = spark.range(30).selectExpr("concat('a', id) as id", "id * 97 % 1000 + if(id % 3 = 0, 5000, 0) as x", "id * 59 % 1000 as y")
    return points, targets


def test_camera_join_compares_the_near(spark):
    from parcelflow.operators import spatial

    p, t = dense(spark)
    degrees = lambda df, x, y: df.withColumns({x: F.lit(-118.15) + F.col("x") / 1e6, y: F.lit(34.18) + F.col("y") / 1e6}).drop("x", "y")
    p, t = degrees(p, "plon", "plat"), degrees(t, "lon", "lat")
    got, most, _ = joined(spatial.camera_join(t, p, most=100))
    assert most < 20 * 1000  # of all pairs within the radius it would be 20 * 20000
    points, assets = p.collect(), [a for a in t.collect() if a["lon"] < -118.148]
    want = {(a["id"], e["event_id"]) for a in assets for e in sorted(points, key=lambda e: ((e["plon"] - a["lon"]) ** 2 + (e["plat"] - a["lat"]) ** 2, e["event_id"]))[:100]}
    assert {(r["id"], r["event_id"]) for r in got} == want and len(got) == 2000


def copies(spark, sf, folder, n, far=152000):
    """The tables of the rays' queries with events n times, each copy at the places of the first."""
    spark.read.parquet(f"{sf}/customer.parquet").write.parquet(f"{folder}/customer.parquet")
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.crossJoin(spark.range(n).select(F.col("id").alias("__n"))).withColumn("event_id", F.col("event_id") + F.col("__n") * far).drop("__n").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_rays_take_one_camera_of_a_place(spark, sf, tmp_path):
    from parcelflow.plans import catalog

    one, pairs, _ = joined(catalog.jn6_win1_best_by_ray(spark, sf))
    many, of_many, broadcast = joined(catalog.jn6_win1_best_by_ray(spark, copies(spark, sf, tmp_path, 6)))
    assert sorted(map(str, one)) == sorted(map(str, many)) and any(r["event_id"] is not None for r in one)
    assert of_many == pairs and not broadcast


def test_best_of_rays_needs_no_sort(spark):
    from parcelflow.operators import spatial

    rows = [(f"a{k % 5}", k % 4, "face", (k * 37) % 101 / 10 + (k % 3) * 1e-8, (k * 7919) % 997 - 500 + (k % 2) * (2**63 - 1000)) for k in range(2000)]
    m = spark.createDataFrame([*rows, ("a9", 0, "face", 9.87654321, -(2**63)), ("a9", 90, "face", 0.0, 2**63 - 1)], "id string, angle int, axis string, perp double, event_id bigint")
    want = {}
    for r in m.collect():
        want.setdefault((r["id"], r["angle"]), []).append((round(r["perp"], 6), r["event_id"]))
    want = {k: min(v)[1] for k, v in want.items()}
    best = spatial.best_by_named_ray(m)
    assert {(r["id"], r["angle"]): r["event_id"] for r in best.collect()} == want
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()
    named = spatial.best_by_named_ray(m.withColumn("event_id", F.concat(F.lit("e"), F.col("event_id").cast("string")))).schema["event_id"]
    assert named.dataType.typeName() == "string" and best.schema["event_id"].dataType.typeName() == "long"


def test_views_are_tested_once_a_place(spark, sf, tmp_path):
    from parcelflow.plans import catalog

    one, pairs, _ = joined(catalog.jn7_clear_views(spark, sf))
    many, of_many, _ = joined(catalog.jn7_clear_views(spark, copies(spark, sf, tmp_path, 6)))
    assert sorted(map(str, one)) == sorted(map(str, many)) and one
    assert of_many == pairs


def test_box_joins_broadcast_a_short_list_only(spark, sf):
    from parcelflow.plans import catalog

    assert [joined(catalog.QUERIES[n](spark, sf))[2] for n in ("jn4_neighbours", "set4_box_overlap_join", "jn3_extent_join")] == [False, False, True]


def test_flagship_takes_one_camera_of_a_place(spark, sf, tmp_path):
    from parcelflow.plans import catalog

    one, pairs, _ = joined(catalog.udf12_win2_win3_localise(spark, sf))
    many, of_many, _ = joined(catalog.udf12_win2_win3_localise(spark, copies(spark, sf, tmp_path, 4)))
    assert sorted(map(str, one)) == sorted(map(str, many)) and one
    assert of_many == pairs
    plan = catalog.udf12_win2_win3_localise(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("Join Inner") == 1  # the lines with the boxes, and no rays of all assets


def test_hundred_nearest_of_hot_places(spark, monkeypatch):
    from parcelflow.operators import spatial

    monkeypatch.setattr(spatial, "HOT", 500)
    r = random.Random(5)
    at = [(7.0, 7.0)] * 6000 + [(r.uniform(-300, 300), r.uniform(-300, 300)) for _ in range(1500)] + [(r.gauss(50, 3), r.gauss(50, 3)) for _ in range(1500)] + [(float("nan"), 7.0), (7.0, float("inf")), (None, 7.0)]
    ids = r.sample(range(-(10**6), 10**6), len(at))
    points = spark.createDataFrame([(i, *a) for i, a in zip(ids, at)], "event_id bigint, x double, y double")
    spots = [(7.0, 7.0), (8.0, 7.0), (50.0, 50.0), (70.0, 50.0), (-250.0, -250.0), (900.0, 0.0), (330.0, 0.0), (float("nan"), 7.0), (None, 7.0), *((r.uniform(-300, 300), r.uniform(-300, 300)) for _ in range(20))]
    targets = spark.createDataFrame([*((f"t{k}", *s) for k, s in enumerate(spots)), ("twice", 7.0, 8.0), ("twice", -90.0, 40.0), (None, 20.0, 20.0)], "id string, x double, y double")
    got, most, _ = joined(spatial.nearest(points, targets, 150.0, 100, "event_id", "id"))
    want = []
    real = [(i, x, y) for i, (x, y) in zip(ids, at) if x is not None and x == x and y < 1e9]
    spots = {}
    for t in targets.collect():
        spots.setdefault(t["id"], []).append((t["x"], t["y"]))
    for k, places in spots.items():
        d = sorted((d2, i) for x, y in places if x is not None for i, px, py in real if (d2 := (px - x) ** 2 + (py - y) ** 2) <= 150.0**2)
        want += [(k, i, n + 1) for n, (_, i) in enumerate(d[:100])]
    assert sorted(map(str, want)) == sorted(str((r["id"], r["event_id"], r["rank"])) for r in got) and len(want) > 2000
    assert most < 40000  # of all pairs within the radius it would be over 150000


def test_nearest_cameras_broadcast_no_side(spark):
    from parcelflow.operators import spatial

    p, t = dense(spark)
    got, most, broadcast = joined(spatial.nearest(p, t, 300, 5, "event_id", "id"))
    assert len(got) == 100 and most < 20 * 300 and not broadcast
