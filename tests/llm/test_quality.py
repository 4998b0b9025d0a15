from collections import Counter

import duckdb

from parcelflow.llm import quality as Q


def brute(text: str) -> dict:
    import re

    w = re.findall(r"[^\t\n\x0b\f\r ]+", text)
    out = {"n_words": len(w), "word_chars": sum(map(len, w))}
    for n in Q.NGRAMS:
        g = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        hit = {k for i in range(len(w) - n + 1) if g[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out[f"dup_{n}"] = sum(len(w[k]) for k in hit)
    lines = [x for x in (y.strip("\t\n\x0b\f\r ") for y in text.split("\n")) if x]
    seen, copies = set(), []
    for x in lines:
        copies += [x] if x in seen else []
        seen.add(x)
    return out | {"n_lines": len(lines), "line_chars": sum(map(len, lines)), "dup_lines": len(copies), "dup_line_chars": sum(map(len, copies))}


TEXTS = [
    "a b c d e f a b c d e f", "one line\none line\n  one line \nother", "la " * 50, "é ñ ü é ñ ü é ñ ü é ñ ü", "x\n\n\n\nx", "  ", "", "a b c d e\na b c d e\nf g h", "p q r s t u v w x y z " * 3 + "tail", "\n lead", "a\tb\x0bc a\tb\x0bc",
]


def test_against_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    for r in Q.repetition(df).collect():
        want = brute(TEXTS[r["doc_id"]])
        assert {k: r[k] for k in want} == want, TEXTS[r["doc_id"]]


def test_against_sql(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.sql(Q.SQL).df().sort_values("doc_id", ignore_index=True)
    got = Q.repetition(df).toPandas().sort_values("doc_id", ignore_index=True)
    assert got[sorted(got)].astype(int).equals(want[sorted(want)].astype(int))


def test_odd_rows(spark, odd, empty):
    got = Q.repetition(odd).collect()
    assert len(got) == odd.count()
    assert all(not r["keep"] for r in got if r["doc_id"] in (4, 5, 6))
    assert all(r["keep"] for r in got if r["doc_id"] in (1, 2, 3, 7, 8, 13))
    assert Q.repetition(empty).count() == 0
