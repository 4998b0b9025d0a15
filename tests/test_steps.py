import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from parcelflow.models import base, steps
from parcelflow.operators import graph
from parcelflow.plans.pipeline import Pipeline
from parcelflow.streaming import ingest


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.createDataFrame([("a", 0, '{"asset_type":"pole"}'), ("b", 1, '{"asset_type":"wall"}'), ("c", 2, "{}")], "id string, ord bigint, j string").select("id", "ord", F.from_json("j", "map<string,variant>").alias("attrs"))
    i = spark.createDataFrame([("a", 1, "i2", "/2.jpg"), ("a", 0, "i1", "/1.jpg"), ("b", 0, "i3", "/bad.jpg")], "asset_id string, ord bigint, id string, path string")
    return a, i


def answers():
    def answer(images, prompt):
        if "/bad.jpg" in images:
            raise RuntimeError("no")
        return f"Level: 3\nSeen: {len(images)}"

    return base.StubBackend(answer)


def test_analyse(spark, tables):
    got = {r["id"]: json.loads(r["j"]) for r in steps.analyse(*tables, answers, "prompt", prefix="m", most_images=1).select("id", F.to_json("attrs").alias("j")).collect()}
    assert got["a"] == {"asset_type": "pole", "m_level": "3", "m_seen": "1", "ai_model_used": "stub", "images_analyzed_count": 1}
    assert got["b"] == {"asset_type": "wall"} and got["c"] == {}
    raw = steps.analyse(*tables, lambda: base.StubBackend(lambda i, p: "no lines here"), "p", prefix="m")
    assert "m_analysis_raw" in json.loads(raw.where("id = 'a'").select(F.to_json("attrs")).first()[0])


def test_failures_are_rows(spark, tables):
    got = {r["id"]: r for r in base.infer(steps.asset_images(*tables), answers, "p").collect()}
    assert got["a"]["status"] == "ok" and got["b"]["status"] == "failed" and "no" in got["b"]["error"]


def test_segment_and_labels(spark, tables):
    boxes = steps.segment(*tables, base.StubBackend, ["roof", "wall"]).collect()
    assert {(r["asset_id"], r["image_id"]) for r in boxes} == {("a", "i1"), ("a", "i2"), ("b", "i3")} and all(len(r["box"]) == 4 for r in boxes)
    labels = steps.map_labels(tables[0], lambda: base.StubBackend(lambda i, p: '["x", "road"]' if i == ["pole"] else None), "p", ["road"])
    assert {r["asset_type"]: r["labels"] for r in labels.collect()} == {"pole": ["road"], "wall": []}


def test_retry_and_prompt(tmp_path):
    tries = []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 7

    waits = []
    assert base.with_retry(call, sleep=waits.append) == 7 and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        base.with_retry(lambda: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)
    (tmp_path / "p.txt").write_text("from file\n")
    assert base.resolve_text(str(tmp_path / "p.txt")) == "from file" and base.resolve_text("plain") == "plain"


def test_pipeline_order(spark):
    def my_exporter(df):
        return df.withColumn("o", F.concat("o", F.lit("3")))

    def image_extractor(df):
        return df.withColumn("o", F.concat("o", F.lit("1")))

    class Classifier:
        def __call__(self, df):
            return df.withColumn("o", F.concat("o", F.lit("2")))

    df = spark.createDataFrame([("",)], "o string")
    assert Pipeline([my_exporter, Classifier(), image_extractor]).run(df).first()["o"] == "123"
    with pytest.warns(UserWarning):
        Pipeline().run(df)
    with pytest.raises(TypeError):
        Pipeline().add(3)


def test_components_of_nothing(spark):
    n = spark.createDataFrame([(1,), (2,)], "id bigint")
    e = spark.createDataFrame([], "a bigint, b bigint")
    assert {(r["id"], r["root"]) for r in graph.components(n, e).collect()} == {(1, 1), (2, 2)}


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.limit(200).union(events.limit(200)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = []
    q = ingest.fresh_images(stream).writeStream.foreachBatch(lambda df, _: out.append(df.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(out) == 200
    q = ingest.counts(stream, late="1 second").writeStream.format("memory").queryName("c").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from c").first()[0] == 400
    from parcelflow.plans import fixtures

    placed = stream.select("event_id", ((F.col("event_id") * 6007) % 8000).alias("px"), ((F.col("event_id") * 5003) % 7600).alias("py"))
    q = ingest.near_assets(placed, fixtures.assets(spark, sf).select("id", "minx", "miny", "maxx", "maxy"), 300).writeStream.format("memory").queryName("n").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select count(*) from n").first()[0] > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
