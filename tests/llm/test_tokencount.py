import functools
import math
import random
import time
from collections import Counter

from parcelflow.llm import textkit as tk
from parcelflow.llm import tokencount as T

SMALL = T.pieces({b"a": -2.0, b"b": -2.5, b"ab": -3.0, b"abc": -3.1, b"bc": -4.0, b"c": -6.0, T.MARK: -1.0, T.MARK + b"a": -2.2, "é".encode(): -3.0, b"aa": -3.9})


def best(word: bytes, scores: dict[bytes, float]) -> tuple[int, float]:
    """Tokens and score by trying every last piece, shortest first."""
    score, count = [0.0], [0]
    for d in range(1, len(word) + 1):
        top, n = max(((score[k] + scores.get(word[k:d], T.BYTE_SCORE if d - k == 1 else -math.inf), k) for k in range(d - 1, -1, -1)), key=lambda x: x[0])
        score.append(top)
        count.append(count[n] + 1)
    return count[-1], score[-1]


def of(v: T.Pieces) -> dict[bytes, float]:
    return {p: s for p, s in v.ends.items() if s != T.TAIL}


def test_trie_agrees_with_every_segmentation():
    r = random.Random(1)
    ws = list({T.MARK + "".join(r.choice("abcéx") for _ in range(r.choice((3, 6, 12, 100, 400)))).encode() for _ in range(300)})
    ws += [ws[0] + b"a" * k for k in (1, 50, 90)] + [T.MARK]
    t, s = T.trie_counts(ws, SMALL)
    for w, n, x in zip(ws, t, s):
        m, y = best(w, of(SMALL))
        assert m == n and abs(x - y) < 1e-9
    assert all(len(x) == 0 for x in T.trie_counts([], SMALL))


def test_real_vocabulary():
    v = T.load()
    text = "the quick Überraschung naïve 12345 人工智能人工智能人工智能人工智能 antidisestablishmentarianism ❤ " + "aGVsbG8gd29ybGQ" * 8
    ws = [("▁" + w).encode() for w in text.split()]
    t, s = T.trie_counts(ws, v)
    own = of(v)
    for w, n, x in zip(ws, t, s):
        m, y = best(w, own)
        assert m == n and abs(x - y) < 1e-9


def test_against_an_independent_unigram_model():
    from tokenizers import Tokenizer, models

    r = random.Random(2)
    texts = {"a": -2.0, "b": -2.5, "ab": -3.03, "abc": -3.17, "bc": -4.01, "c": -6.0, "aa": -3.9, "ca": -5.03}
    v = T.pieces({k.encode(): s for k, s in texts.items()})
    tok = Tokenizer(models.Unigram([("<unk>", -30.0), *texts.items()], 0, False))
    ws = ["".join(r.choice("abc") for _ in range(r.randrange(1, 200))) for _ in range(200)]
    assert T.trie_counts([w.encode() for w in ws], v)[0].tolist() == [len(tok.encode(w).tokens) for w in ws]


def test_time_is_linear_in_a_word():
    v, r = T.load(), random.Random(5)

    def took(n: int) -> float:
        w = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)).encode()
        start = time.perf_counter()
        T.trie_counts([w, w + b"x"], v)
        return time.perf_counter() - start

    assert min(took(80_000) for _ in range(3)) < 6 * min(took(20_000) for _ in range(3)) + 0.01


def test_counts_of_documents(spark, odd, empty):
    own = of(T.load())
    memo = functools.cache(lambda w: best(w, own)[0])
    got = Counter((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in T.count(odd).collect())
    want: Counter = Counter()
    for r in odd.collect():
        ws = [T.MARK + w.encode() for w in (r["text"] or "").split()]
        if all(len(w) < 1000 for w in ws):
            want[r["doc_id"], len(ws), sum(map(memo, ws))] += 1
    assert all(got[k] == n for k, n in want.items()) and sum(got.values()) == odd.count() == sum(want.values()) + 1
    assert T.count(empty).count() == 0


def test_memory_bound_changes_nothing():
    import pyarrow as pa

    text = pa.array([" ".join(f"w{k % 50}x{k}" for k in range(300)), "w1x1 w2x2"] * 3)
    runs = []
    for most in (10**6, 5):
        c = T.Counter(SMALL, most)
        runs.append([c.of(buf, offs)[1].tolist() for _, _, buf, offs in tk.chunked(tk.plain(text), 400)])
    assert runs[0] == runs[1]


def test_scores_are_log_probabilities():
    v = T.load()
    assert abs(sum(math.exp(s / T.UNIT) for s in of(v).values()) - 1) < 1e-3


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(T.sql()).fetchall()
    got = T.op6_token_counts(spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(got) >= 200
