import random
import re
from collections import defaultdict

import numpy as np
import pytest

from parcelflow.llm import suffixdedup as S
from parcelflow.llm import textkit as tk


def toks(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())


def brute(rows, length):
    at = defaultdict(set)
    for i, t in rows:
        if i is not None and t:
            w = toks(t)
            for p in range(len(w) - length + 1):
                at[tuple(w[p : p + length])].add((i, p))
    win = {}
    for places in at.values():
        if len(places) > 1:
            for x in places:
                win[x] = (len(places), *min(places))
    out, done = set(), set()
    for d, p in sorted(win):
        if (d, p) in done:
            continue
        n, fd, fp = win[d, p]
        q = p
        while win.get((d, q + 1)) == (n, fd, fp + q + 1 - p):
            q += 1
        done |= {(d, x) for x in range(p, q + 1)}
        out.add((d, p, q + length, n, fd, fp, (d, p) != (fd, fp)))
    return out


def found(df, length):
    return {tuple(r) for r in S.repeats(df, length).collect()}


def corpus(seed):
    r = random.Random(seed)
    shared = [f"s{k}" for k in range(70)]
    rows = []
    for k in range(40):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randrange(0, 90))]
        if k % 3 == 0:
            a = r.randrange(0, 40)
            w[len(w) // 2 : len(w) // 2] = shared[a : a + r.randrange(5, 31)]
        if k % 7 == 0:
            w += w[:30]
        rows.append((k, " ".join(w)))
    return rows + [(100 + k, rows[k][1]) for k in range(5)] + [(200, "la " * 120), (201, "la " * 60)]


@pytest.mark.parametrize("length", [8, 20])
@pytest.mark.parametrize("limit", [1, 4, 10**7])
def test_against_brute_force(spark, length, limit, monkeypatch):
    monkeypatch.setattr(S, "HOT", limit)
    rows = corpus(length)
    want = brute(rows, length)
    assert want and found(spark.createDataFrame(rows, "doc_id bigint, text string"), length) == want


def test_equal_windows_share_an_anchor():
    r = random.Random(4)
    w = [f"w{r.randrange(40)}" for _ in range(400)]
    h = np.array(tk.word_hash(*w), np.uint64)
    p, at, g = S.anchors(h, np.array([0, 400]), 20)
    assert p.tolist() == list(range(381)) and all(g[a] == g[x : x + 11].min() and x <= a <= x + 10 for x, a in zip(p, at))
    for s in range(0, 381, 3):
        other = np.concatenate([h[::-1][:50], h[s : s + 20], h[100:120]])
        _, there, _ = S.anchors(other, np.array([0, len(other)]), 20)
        assert there[50] - 50 == at[s] - s


def test_windows_stay_inside_rows():
    h = tk.mix(np.arange(100, dtype=np.uint64))
    p, at, _ = S.anchors(h, np.array([0, 10, 10, 45, 100]), 20)
    assert p.tolist() == [*range(10, 26), *range(45, 81)]


def test_fewer_anchors_than_tokens():
    h = tk.mix(np.arange(20_000, dtype=np.uint64))
    assert len(np.unique(S.anchors(h, np.array([0, 20_000]))[1])) < 20_000 / 10


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd, S.LENGTH) == brute(rows, S.LENGTH)
    assert found(empty, S.LENGTH) == set()
