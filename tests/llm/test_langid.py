from collections import Counter

import numpy as np
import pyarrow as pa

from parcelflow.llm import langid as L
from parcelflow.llm import textkit as tk


def buckets(t: str) -> Counter:
    out = Counter()
    for size in L.NGRAMS:
        for i in range(len(t) - size + 1):
            x = 0
            for c in t.lower()[i : i + size]:
                x = ((x + (int(tk.mix(ord(c) + 1)) | 1)) * 0x9E3779B97F4A7C15) & (2**64 - 1)
            out[x >> (64 - L.BITS)] += 1
    return out


def test_sparse_counts_against_brute_force():
    texts = ["abcab", "", "é a", "aaaa" * 5, "日本語 ßé 🙂x"]
    low = tk.lowered(pa.array(texts))
    for _, _, buf, offs in tk.chunked(low):
        r, k, n = L.pairs(buf, offs)
        for row, t in enumerate(texts):
            assert dict(zip(k[r == row].tolist(), n[r == row].tolist())) == buckets(t)


def test_fit_against_brute_force(spark):
    rows = [(1, "Aé b", "x"), (2, "ab", "x"), (3, "日本 é", "y"), (4, None, "y"), (5, "zz", None), (6, "", "x")]
    m = L.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert m.langs == ["x", "y"] and np.allclose(m.prior / L.UNIT, np.log([2 / 3, 1 / 3]), atol=1e-5)
    for c, texts in enumerate((["Aé b", "ab"], ["日本 é"])):
        n = sum(map(buckets, texts), Counter())
        total = sum(n.values()) + L.SMOOTHING * (1 << L.BITS)
        assert np.allclose(m.log_prob[:, c] / L.UNIT, [np.log((n[b] + L.SMOOTHING) / total) for b in range(1 << L.BITS)], atol=1e-5)


def test_held_out_accuracy(spark):
    docs = tk.table(spark, "/root/testdata/sf0.01", "documents")
    m = L.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    j = L.score(held, m).join(held.select("doc_id", "lang"), "doc_id").where("n_grams > 100")
    n, ok = j.count(), j.where("lang = lang_pred").count()
    assert ok >= 0.99 * n and m.log_prob.shape == (1 << L.BITS, len(m.langs))


def test_bound_of_training_rows(spark):
    docs = tk.table(spark, "/root/testdata/sf0.001", "documents")
    assert set(L.fit(docs, train_rows=5).langs) <= {"en", "de", "fr", "es"}


def test_odd_rows(spark, odd, empty):
    m = L.fit(odd)
    got = L.score(odd, m).collect()
    assert len(got) == odd.count() and all((r["lang_pred"] is None) == (r["n_grams"] == 0) for r in got)
    none = L.fit(empty)
    assert none.langs == [] and all(r["lang_pred"] is None for r in L.score(odd, none).collect())
    assert L.score(empty, m).count() == 0


def test_scores_are_those_of_the_formula():
    p = np.log(np.random.default_rng(0).dirichlet(np.ones(1 << L.BITS), 2).T)
    m = L.Model(["a", "b"], np.rint(p * L.UNIT).astype(np.int32), np.rint(np.log([0.3, 0.7]) * L.UNIT))
    text = pa.array(["some text here", None])
    low = tk.lowered(text)
    _, _, buf, offs = next(iter(tk.chunked(low)))
    r, k, n = L.pairs(buf, offs)
    want = [float((m.log_prob[k[r == 0], c].astype(float) * n[r == 0]).sum() + m.prior[c]) for c in (0, 1)]
    out = L.predict(text, m)
    assert out[1].to_pylist() == [m.langs[int(np.argmax(want))], None] and out[2][0].as_py() == max(want) / L.UNIT


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, L.op7_language_id(spark, sf).collect()), key=repr) == sorted(con.sql(L.SQL).fetchall(), key=repr)
