import re
import shutil
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from test_decontaminate import toks
from test_jaccard import grams, near
from parcelflow.llm import decontaminate, jaccard, packing, secrets, toxicity
from parcelflow.llm import textkit as tk


@pytest.fixture(scope="module")
def steps(spark):
    d = "/root/testdata/sf0.01"
    docs = tk.table(spark, d, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, d)
        out.append(got.collect())
        docs = spark.createDataFrame(out[-1], got.schema)
    return d, out


def test_stages_and_registration():
    assert [f.__module__.rsplit(".", 1)[1] for _, f in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "decontaminate", "secrets", "packing"]
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_each_decision_takes_effect(spark, steps):
    d, out = steps
    cols = out[0][0].__fields__
    assert all(r.__fields__ == cols for step in out[:5] for r in step)
    frame = lambda rows: spark.createDataFrame(rows, tk.table(spark, d, "documents").schema)
    ids = [{r["doc_id"] for r in step} for step in out]
    toxic = {r["doc_id"] for r in toxicity.score(frame(out[0]), toxicity.fit(frame(out[0]), tk.table(spark, d, "labels"))).collect() if r["toxic"]}
    assert toxic and ids[1] == ids[0] - toxic
    sets = [(r["doc_id"], grams(r["text"])) for r in out[1] if r["text"] and grams(r["text"])]
    linked = defaultdict(set)
    for k, (a, x) in enumerate(sets):  # all pairs
        for b, y in sets[:k]:
            if min(len(x), len(y)) >= jaccard.T * max(len(x), len(y)) - 1e-9 and near(x, y):
                linked[a].add(b), linked[b].add(a)
    kept = set()
    seen: set = set()
    for i in sorted(ids[1]):
        if i not in seen:
            kept.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += linked[x]
    assert ids[2] == kept and len(kept) < len(ids[1])
    leaked = {r["doc_id"] for r in decontaminate.contaminated(frame(out[2]), tk.table(spark, d, "benchmark")).collect()}
    assert leaked and ids[3] == ids[2] - leaked
    items = [f" {' '.join(toks(r['text']))} " for r in tk.table(spark, d, "benchmark").collect()]
    whole = {r["doc_id"] for r in out[2] if any(i in f" {' '.join(toks(r['text']))} " for i in items)}
    assert whole and whole <= leaked
    pairs_of = lambda t: set(zip(toks(t), toks(t)[1:]))
    known = set().union(*(pairs_of(i) for i in items))
    assert all(len(pairs_of(r["text"]) & known) >= 5 for r in out[2] if r["doc_id"] in leaked)
    texts = {r["doc_id"]: r["text"] for r in out[3]}
    changed = [r for r in out[4] if r["text"] != texts[r["doc_id"]]]
    assert changed and all(re.fullmatch(".*".join(map(re.escape, r["text"].split(secrets.MASK))), texts[r["doc_id"]], re.S) for r in changed)
    assert ids[4] == ids[3] and not any(r["secret"] for r in secrets.scan(frame(out[4])).collect()) and any(r["secret"] for r in secrets.scan(frame(out[3])).collect())
    assert {r["doc_id"] for r in out[5]} == ids[4]
    slots = defaultdict(list)
    for r in out[5]:
        slots[r["bin_id"]].append((r["bin_offset"], r["length"]))
    assert all(sum(n for _, n in s) <= packing.CAPACITY for s in slots.values())


def test_run_gives_the_last_stage(spark, steps):
    d, out = steps
    got = {(r["doc_id"], r["piece"], r["start"], r["length"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {(r["doc_id"], r["piece"], r["start"], r["length"]) for r in out[5]}


def test_odd_documents_pass_through(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} >= {3, 4, 5, 6, 7, 8, 9, 10, 12, None}


def test_empty_documents(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
