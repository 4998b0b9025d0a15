import hashlib

import pytest
from pyspark.sql import functions as F

from parcelflow.llm import warc as W

CRLF = b"\r\n"


def raw_records():
    rec = lambda head, body, tail=CRLF * 2: CRLF.join([b"WARC/1.1", *head]) + CRLF * 2 + body + tail
    long = b"z" * 300_000
    return [
        (1, rec([b"WARC-Type: response", b"Content-Length: 5"], b"hello")), (2, rec([b"Content-Length: 5", b"X: \xff\xfe"], b"hello")), (3, rec([b"content-length: 6"], b"a\r\n\r\nb")),
        (4, b""), (5, b"no blank line"), (6, rec([b"Content-Length: 999"], b"short")), (7, rec([b"X: y"], b"no length")), (None, rec([b"Content-Length: 0"], b"")), (8, None), (1, rec([b"WARC-Type: response", b"Content-Length: 5"], b"hello")),
        (9, rec([b"Content-Length: 300000"], long)), (10, rec([b"Content-Length: 300000"], long)), (11, rec([b"Content-Length: 2"], bytes([0, 255]))),
    ]


@pytest.mark.parametrize("hot", [1, 10_000])
def test_exact_round_trip_and_single_payloads(spark, hot, monkeypatch):
    monkeypatch.setattr(W, "HOT", hot)
    rows = raw_records()
    df = spark.createDataFrame(rows, "page_id bigint, raw binary").withColumn("digest", F.lit("clash")).withColumn("payload", F.lit("clash"))
    heads, payloads = W.archive(df)
    got = W.reconstruct(heads, payloads).collect()
    key = lambda x: (x[0] is None, x[0] or 0, bytes(x[1]))
    assert sorted(((r["page_id"], bytes(r["raw"])) for r in got), key=key) == sorted((r for r in rows if r[1] is not None), key=key)
    assert all(r["intact"] for r in got)
    stored = payloads.collect()
    assert len(stored) == len({bytes(r["payload"]) for r in stored}) and all(hashlib.sha256(bytes(r["payload"])).hexdigest() == r["digest"] for r in stored)
    assert {bytes(r["payload"]): r["copies"] for r in stored}[b"hello"] == 3


def test_a_damaged_payload_is_seen(spark):
    df = spark.createDataFrame(raw_records()[:3], "page_id bigint, raw binary")
    heads, payloads = W.archive(df)
    bad = payloads.withColumn("payload", F.when(F.col("copies") == 2, F.lit("jello").cast("binary")).otherwise(F.col("payload")))
    assert {r["page_id"]: r["intact"] for r in W.reconstruct(heads, bad).collect()} == {1: False, 2: False, 3: True}


def test_payloads_of_one_digest_are_compared_byte_for_byte(spark, monkeypatch):
    monkeypatch.setattr(W.F, "sha2", lambda c, n: F.lit("same"))  # as if all collided
    _, payloads = W.archive(spark.createDataFrame(raw_records()[:3], "page_id bigint, raw binary"))
    assert [(r["copies"], r["verified"]) for r in payloads.collect()] == [(3, False)]


def test_payload_crosses_once(spark):
    df = spark.createDataFrame(raw_records(), "page_id bigint, raw binary")
    plan = W.reconstruct(*W.archive(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(digest") <= 2  # heads, and payloads for grouping and joining


def test_pages(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, None, None), (None, "u", ""), (1, "http://a", "<p>é</p>")]
    got = W.reconstruct(*W.archive(W.records(spark.createDataFrame(rows, "page_id bigint, url string, html string")))).collect()
    assert len(got) == 4 and all(r["intact"] for r in got)
    assert W.reconstruct(*W.archive(W.records(spark.createDataFrame([], "page_id bigint, url string, html string")))).count() == 0
