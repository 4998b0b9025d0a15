import pytest
from pyspark.sql import functions as F

from parcelflow.functions import attrs as A
from parcelflow.functions import boxes, geo
from parcelflow.functions import text as X
from parcelflow.operators import collection as C
from parcelflow.operators import keyed, merge

ROWS = [
    ("a1", 0, 0.0, 0.0, '{"type":"pole","status":"active","height":10}'),
    ("a2", 1, 10.0, 10.0, '{"type":"pole","status":"inactive","height":20}'),
    ("a3", 2, 20.0, 20.0, '{"category":"valve","status":"repair","tags":["urgent"]}'),
]


@pytest.fixture(scope="module")
def coll(spark):
    df = spark.createDataFrame(ROWS, "id string, ord bigint, x double, y double, j string")
    return df.select("id", "ord", F.col("x").alias("minx"), F.col("y").alias("miny"), F.col("x").alias("maxx"), F.col("y").alias("maxy"), F.from_json("j", "map<string,variant>").alias("attrs"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_attribute_filters(coll):
    f = lambda *a: ids(A.filter_by_attribute(coll, *a))
    assert f("type", "pole", "==") == ["a1", "a2"] and f("height", 15, ">") == ["a2"]
    assert f("status", ["active", "inactive"], "in") == ["a1", "a2"] and f("tags", "urgent", "contains") == ["a3"] and f("category", None, "exists") == ["a3"]
    assert f("height", 10, "!=") == ["a2"] and f("height", "x", ">") == [] and f("missing", 1, "!=") == [] and f("status", "re", "contains") == ["a3"]
    assert f("status", "repair or active", "in") == ["a1", "a3"] and f("height", 10.0, "==") == ["a1"] and f("height", 20, ">=") == ["a2"] and f("height", 20, "<") == ["a1"]
    with pytest.raises(ValueError):
        A.filter_by_attribute(coll, "type", "pole", "like")


def test_null_and_absent_differ(spark):
    df = spark.createDataFrame([("n", '{"k":null}'), ("a", "{}"), ("v", '{"k":1}')], "id string, j string").select("id", F.from_json("j", "map<string,variant>").alias("attrs"))
    assert ids(A.filter_by_attribute(df, "k", None, "exists")) == ["n", "v"] and ids(A.filter_by_attribute(df, "k", None)) == ["n"]
    assert ids(A.filter_by_property(df, "k", None, "attrs")) == ["a", "n"] and ids(A.filter_empty(df)) == ["n", "v"]


def test_geometry_filters(coll):
    b = boxes.literal(5, 5, -5, -5)
    assert ids(C.filter_by_box(coll, b)) == ["a1"] and ids(C.filter_by_box(coll, b, "within")) == ["a1"]
    assert ids(C.filter_by_box(coll, boxes.literal(0, 0, 5, 5), "within")) == [] and ids(C.filter_by_box(coll, boxes.literal(0, 0, 5, 5), "touches")) == ["a1"]
    assert ids(C.filter_by_box(coll, b, "disjoint")) == ["a2", "a3"]
    with pytest.raises(ValueError):
        C.filter_by_box(coll, b, "near")


def test_set_attributes(coll):
    get = lambda c, k: {r["id"]: r["v"] for r in coll.select("id", F.try_variant_get(A.value(c, k), "$", "string").alias("v")).collect()}
    assert get(A.with_attributes(F.col("attrs"), {"height": 99}), "height") == {"a1": "10", "a2": "20", "a3": "99"}
    assert set(get(A.with_attributes(F.col("attrs"), {"height": 99}, True), "height").values()) == {"99"}
    assert get(A.with_type(F.col("attrs"), "new"), "asset_type") == dict.fromkeys(("a1", "a2", "a3"), "new")
    with pytest.raises(TypeError):
        A.with_attributes(F.col("attrs"), [1])


def test_summary(coll):
    got = {r["asset_type"]: (r["assets"], r["minx"], r["maxx"]) for r in C.summary(coll).collect()}
    assert got == {"pole": (2, 0.0, 10.0), "valve": (1, 20.0, 20.0), None: (3, 0.0, 20.0)}


def test_slices_and_positions(coll):
    seq = lambda df: [r["id"] for r in df.orderBy("ord").collect()]
    every = ["a1", "a2", "a3"]
    for s in (slice(None), slice(None, None, -1), slice(2, None, -2), slice(-2, None), slice(0, 0), slice(1, 10)):
        assert seq(keyed.sliced(coll, s.start, s.stop, s.step)) == every[s]
    assert ids(keyed.nth(coll, -1)) == ["a3"] and ids(keyed.nth(coll, 1)) == ["a2"]
    for i in (3, -4):
        with pytest.raises(IndexError):
            keyed.nth(coll, i)
    got = [(r["place"], r["id"], r["ord"]) for r in keyed.get(coll, ["a2", "zz", "a2"]).orderBy("place").collect()]
    assert got == [(0, "a2", 1), (1, "zz", None), (2, "a2", 1)]


def pair(spark):
    l = spark.createDataFrame([("a1", 0, 0), ("a2", 1, 10)], "id string, ord bigint, x int")
    return l, spark.createDataFrame([("a1", 0, 9), ("b1", 1, 1)], "id string, ord bigint, x int")


def test_merge_strategies(spark):
    l, r = pair(spark)
    rows = lambda s: [(x["id"], x["x"]) for x in merge.merge(l, r, s).orderBy("ord").collect()]
    assert rows("skip") == [("a1", 0), ("a2", 10), ("b1", 1)] and rows("overwrite") == [("a1", 9), ("a2", 10), ("b1", 1)]
    with pytest.raises(ValueError):
        merge.merge(l, r, "raise")
    with pytest.raises(ValueError):
        merge.merge(l, r, "mix")
    assert merge.merge_stats(l, r, "skip").first().asDict() == {"added": 1, "overwritten": 0, "skipped": 1}


def test_add_put_remove(spark):
    l, r = pair(spark)
    rows = lambda df: [(x["id"], x["x"]) for x in df.orderBy("ord").collect()]
    assert rows(keyed.add(l, r)) == [("a1", 0), ("a2", 10), ("b1", 1)] and rows(keyed.put(l, r)) == [("a1", 9), ("a2", 10), ("b1", 1)]
    assert rows(keyed.remove(l, ["a1", "q"])) == [("a2", 10)] and rows(keyed.remove(l, r)) == [("a2", 10)]
    assert rows(keyed.add(l.limit(0), r)) == [("a1", 9), ("b1", 1)]


def test_upsert_maps(spark):
    df = spark.sql("select map('a', 1, 'b', 2) as l, map('b', 3, 'c', 4) as r")
    row = df.select(merge.upsert(F.col("l"), F.col("r"), True).alias("o"), merge.upsert(F.col("l"), F.col("r"), False).alias("k"), merge.upsert(F.col("l"), F.lit(None).cast("map<string,int>"), True).alias("n")).first()
    assert row["o"] == {"a": 1, "b": 3, "c": 4} and row["k"] == {"a": 1, "b": 2, "c": 4} and row["n"] == {"a": 1, "b": 2}


def test_boxes(spark):
    one = spark.range(1)
    n = lambda c: one.select(F.size(c).alias("n")).first()["n"]
    assert n(boxes.tile_by_area(boxes.literal(0, 0, 10, 10), 25)) == 4 and n(boxes.tile_by_area(boxes.literal(0, 0, 100, 10), 10)) == 128
    assert n(boxes.tile_by_area(boxes.literal(0, 0, 0, 10), 1)) == 1 and n(boxes.tile_by_area(boxes.literal(0, 0, 1, 1), 2)) == 1
    q = one.select(boxes.split(boxes.literal(0, 0, 10, 10)).alias("q")).first()["q"]
    assert [(x["minx"], x["miny"]) for x in q] == [(0, 0), (5, 0), (0, 5), (5, 5)]
    d = lambda b: one.select(boxes.distance(boxes.literal(0, 0, 10, 10), b).alias("d")).first()["d"]
    assert d(boxes.literal(20, 0, 30, 10)) == 10 and d(boxes.literal(5, 5, 6, 6)) == 0 and d(boxes.literal(10, 0, 12, 3)) == 0
    area = one.select(F.aggregate(boxes.tile_by_area(boxes.literal(0.123, 0.456, 9.789, 7.123), 0.5), F.lit(0.0), lambda s, t: s + (t["maxx"] - t["minx"]) * (t["maxy"] - t["miny"])).alias("a")).first()["a"]
    assert abs(area - (9.789 - 0.123) * (7.123 - 0.456)) < 1e-9


def test_units_and_buffers():
    assert geo.to_metres(1, "Feet") == pytest.approx(0.3048) and geo.to_metres(2, "km") == 2000
    assert geo.parse_buffer("20%") == ("ratio", 0.2) and geo.parse_buffer(3) == ("native", 3.0)
    for bad in ("5 parsecs", "x", "-3"):
        with pytest.raises(ValueError):
            geo.parse_buffer(bad)


def test_names_and_schema(spark):
    assert A.short_names(["very_long_key_a", "very_long_key_b", "x"]) == {"very_long_key_a": "very_long_", "very_long_key_b": "very_long1", "x": "x"}
    df = spark.createDataFrame([("a", 0, '{"k":1,"b":true}'), ("b", 1, '{"k":1.5,"b":false,"s":"t"}'), ("c", 2, '{"m":1}'), ("d", 3, '{"m":"x"}')], "id string, ord bigint, j string").select("id", "ord", F.from_json("j", "map<string,variant>").alias("attrs"))
    assert {r["key"]: r["code"] for r in A.shapefile_schema(df).collect()} == {"k": "F", "b": "L", "s": "C", "m": "C"}
    assert C.distinct_keys(df) == ["k", "b", "s", "m"]


@pytest.mark.parametrize(
    "answer, want",
    [
        ('x\n```json\n{"A b": 1}\n```', {"A b": "1"}), ('{"k": "v"}', {"k": "v"}), ("Level: 3\nNote - good: yes\nLevel: 4", {"level": "4", "note": "good: yes"}), ("[1, 2]", {}), ("Über Höhe: 7", {"über_höhe": "7"}), ("", {}),
    ],
)
def test_answers(spark, answer, want):
    got = spark.createDataFrame([(answer,)], "t string").select(F.transform_values(X.parse_answer(F.col("t")), lambda _, v: F.try_variant_get(v, "$", "string")).alias("m")).first()["m"]
    assert got == want


def test_dates(spark):
    df = spark.sql("select * from values (1, date '2024-01-05'), (2, date '2024-02-01'), (3, null) t(id, d)")
    pick = lambda *b: ids(df.where(X.in_date_range(F.col("d"), *b)))
    assert pick("2024-01-05", "2024-01-31") == [1] and pick(None, None) == [1, 2, 3] and pick("soon", "2024-12-31") == [1, 2] and pick("2024-02-01", None) == [2]
