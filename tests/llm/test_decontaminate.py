import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from parcelflow.llm import decontaminate as D
from parcelflow.llm import textkit as tk


def toks(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def brute(docs, items):
    """Best window of each document and item by exact similarity, and its value."""
    ix = D.build(items)
    weight = dict(zip(ix.keys.tolist(), ix.weights.tolist()))
    rest = D.other_weight(ix)
    feats = lambda t: next(f for _, _, f in D._bigrams(pa.array([t])))
    out = {}
    for row, t in enumerate(docs):
        f, n_words = (feats(t), len(toks(t))) if t else ((), 0)
        for item, n, counts, _, _ in ix.items:
            best = max(((D.similarity(Counter(f[s : s + n - 1].tolist()), None, counts, lambda x: weight.get(x, rest)), -s) for s in range(n_words - n + 1)), default=(0, 0))
            if best[0] >= D.T:
                out[row, item] = (round(best[0], 6), -best[1], -best[1] + n)
    return out


def corpus(seed):
    r = random.Random(seed)
    w = lambda n: [f"w{r.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(w(r.randrange(12, 40)))) for k in range(25)]
    docs = []
    for k in range(60):
        own = toks(items[r.randrange(25)][1])
        if k % 3 == 1:
            own = [f"x{k}" if r.random() < 0.06 else x for x in own]
        docs.append(" ".join(w(r.randrange(0, 120)) + (own if k % 3 else []) + w(r.randrange(0, 60))))
    return docs, items


@pytest.mark.parametrize("seed", range(3))
def test_recall_and_exact_values(seed):
    docs, items = corpus(seed)
    want = brute(docs, items)
    got = {(r, i): (s, a, b) for r, i, a, b, s, d in D.scan(pa.array(docs), D.build(items))}
    assert set(got) <= set(want) and len(set(got) & set(want)) >= 0.95 * len(want) and len(want) >= 30
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def test_without_the_radius_nothing_is_missed(monkeypatch):
    docs, items = corpus(7)
    monkeypatch.setattr(D, "SPAN", 30)
    got = {(r, i): (s, a, b) for r, i, a, b, s, d in D.scan(pa.array(docs), D.build(items), radius=D.BITS)}
    assert got == brute(docs, items)


def test_blocks_guarantee_the_radius_and_leave_few_others():
    r = np.random.default_rng(1)
    fp = r.integers(0, 1 << 32, (1, D.BLOCKS), np.uint32)
    flips = np.zeros((2000, D.BITS), np.uint8)
    for row in flips:
        row[r.choice(D.BITS, r.integers(0, D.RADIUS + 1), replace=False)] = 1
    near = fp ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint32)
    d = D.distances(fp, near)[0]
    assert (d.sum(1) == flips.sum(1)).all() and (d <= D.RADIUS // D.BLOCKS).any(1).all()
    other = r.integers(0, 1 << 32, (20_000, D.BLOCKS), np.uint32)
    assert (D.distances(fp, other)[0] <= D.RADIUS // D.BLOCKS).any(1).mean() < 0.05


def test_fingerprints_of_windows_are_those_of_their_texts():
    text = " ".join(f"w{k % 37}" for k in range(200))
    ix = D.build([(0, text), (1, " ".join(text.split()[20:60]))])
    two = next(f for _, _, f in D._bigrams(pa.array([text])))
    (own, fps), = D._fingerprints([(40, 20, 60), (40, 25, 65)], two, ix)
    assert own[0] == (40, 20, 60) and (fps[0] == ix.items[1][4]).all() and not (fps[1] == fps[0]).all()


def test_exact_copies_are_always_found(spark):
    docs = tk.table(spark, "/root/testdata/sf0.01", "documents")
    bench = tk.table(spark, "/root/testdata/sf0.01", "benchmark").collect()
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, tk.table(spark, "/root/testdata/sf0.01", "benchmark")).collect()}
    items = [(b["item_id"], f" {' '.join(toks(b['text']))} ") for b in bench]
    held = {(d["doc_id"], i) for d in docs.collect() for x in [f" {' '.join(toks(d['text']))} "] for i, t in items if t in x}
    assert held and held <= got


def test_odd_rows_and_parts(spark, odd, empty):
    texts = [r["text"] for r in odd.collect()]
    item = " ".join(texts[2].split()[30:60])
    bench = spark.createDataFrame([(1, item), (2, None), (None, "x"), (3, ""), (4, "x"), (5, item)], "item_id bigint, text string")
    got = D.contaminated(odd, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in got} == {(3, 1, 30, 60), (3, 5, 30, 60), (10, 4, 0, 1)}
    many = D.indexes(bench, most_words=20)
    assert sum(len(p.items) for p in many) == 3 and len(many) > 1
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.contaminated(odd, none).count() == 0 and D.contaminated(empty, bench).count() == 0


def test_rows_shorter_than_the_item(spark):
    r = random.Random(21)
    items = [(k, " ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(15, 60)))) for k in range(30)]
    ix = D.build(items)
    weight = dict(zip(ix.keys.tolist(), ix.weights.tolist()))
    feats = lambda t: next(f for _, _, f in D._bigrams(pa.array([t])))
    docs = []
    for _, t in items:
        w = t.split()
        docs += [" ".join(w[:-1]), " ".join(w[2:]), " ".join(w[: round(0.85 * len(w))]), " ".join(w[: len(w) // 2]), w[0], ""]
    want = {}
    for row, t in enumerate(docs):
        for item, n, counts, _, _ in ix.items:
            if 1 < len(toks(t)) < n:
                sim = D.similarity(Counter(feats(t).tolist()), None, counts, lambda x: weight.get(x, D.other_weight(ix)))
                if sim >= D.T:
                    want[row, item] = (0, len(toks(t)), round(sim, 6))
    assert len(want) == 90 and all(want[6 * k + j, k] for k in range(30) for j in range(3))
    got = {(row, item): (a, e, s) for row, item, a, e, s, _ in D.scan(pa.array(docs), ix)}
    assert got.keys() <= want.keys() and all(got[k] == want[k] for k in got) and len(got) >= 0.95 * len(want)
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} bigint, text string")
    assert {(x["doc_id"], x["item_id"]) for x in D.contaminated(frame(list(enumerate(docs)), "doc_id"), frame(items, "item_id")).collect()} == set(got)


def test_items_of_one_equal_word():
    ix = D.build([(1, "alpha"), (2, "Alpha"), (3, "beta"), (1, "alpha")])
    assert sorted(D.scan(pa.array(["x alpha y", "beta"]), ix)) == [(0, 1, 1, 2, 1.0, 0), (0, 2, 1, 2, 1.0, 0), (1, 3, 0, 1, 1.0, 0)]
