import random
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest

from parcelflow.llm import jaccard as J
from parcelflow.llm import textkit as tk


def grams(t: str) -> frozenset:
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    return frozenset(tuple(w[i : i + J.N]) for i in range(max(1, len(w) - J.N + 1))) if w else frozenset()


def near(a: frozenset, b: frozenset) -> bool:
    return len(a & b) >= J.T * len(a | b) - 1e-12


def brute(rows) -> list:
    """(doc_id, class_id, links) of every row, by all pairs of rows."""
    sets = [grams(t) if i is not None and t else frozenset() for i, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, s in enumerate(sets):
        for y in range(x):
            if s and sets[y] and near(s, sets[y]):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    low = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        low[find(x)].append(i)
    return ordered((i, i if i is None else min(low[find(x)]), n) for x, ((i, _), n) in enumerate(zip(rows, links)))


def ordered(rows) -> list:
    return sorted(rows, key=repr)


def got(df) -> list:
    return ordered((r["doc_id"], r["class_id"], r["links"]) for r in J.near_classes(df).collect())


def corpus(seed=5):
    r = random.Random(seed)
    rows, n = [], 0
    shared = " ".join(f"s{k}" for k in range(20))
    for c in range(12):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randrange(4, 150))]
        for k in range(r.randrange(1, 12)):
            w = [f"x{r.randrange(99)}" if k and r.random() < 0.05 else x for x in base]
            rows.append((n, " ".join(w) + (" " + shared if r.random() < 0.5 else "")))
            n += 1
    return rows + [(n + k, rows[0][1].upper()) for k in range(5)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_against_brute_force(spark):
    rows = corpus()
    assert got(frame(spark, rows)) == brute(rows)


def test_hot_tokens_and_split_groups(spark, monkeypatch):
    rows = corpus(6)
    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "GROUP", 3)
    monkeypatch.setattr(J, "GROUP_TOKENS", 100)
    assert got(frame(spark, rows)) == brute(rows)


def test_dense_pairs_count_once(spark, monkeypatch):
    r = random.Random(9)
    common = [f"s{k}" for k in range(60)]
    rows = [(k, " ".join([f"a{k}x{j}" for j in range(r.randrange(4, 40))] + common)) for k in range(40)]
    monkeypatch.setattr(J, "HOT", 3)
    want = brute(rows)
    assert any(n for *_, n in want) and got(frame(spark, rows)) == want


def test_sql_at_the_smallest_size(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got(tk.table(spark, sf, "documents")) == ordered(con.sql(J.SQL).fetchall())


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert got(empty) == []
    kept = J.stage(spark, odd, "").collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13] and ids.count(None) == 2
    assert kept[0].__fields__ == odd.columns


def test_ids_that_repeat(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a), (1, a), (5, a), (5, a + " x"), (5, c), (7, ""), (7, b), (2, b), (7, b + " more"), (8, c + " y"), (None, a)]
    df = frame(spark, rows)
    assert got(df) == brute(rows)
    kept = [(r["doc_id"], r["text"]) for r in J.stage(spark, df, "").collect()]
    assert sorted(kept, key=repr) == sorted([(1, a), (5, c), (7, ""), (2, b), (None, a)], key=repr)  # no text is lost, and of each class the smallest id stays
    one = frame(spark, [(1, a), (5, a), (5, c)])
    assert {(r["doc_id"], r["text"]) for r in J.stage(spark, one, "").collect()} == {(1, a), (5, c)}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    edges = [e for e in edges if e[0] != e[1]]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x["doc_id"]: x["root"] for x in J.components(spark.createDataFrame(edges, "doc_a bigint, doc_b bigint")).collect()}
    assert got == {i: find(i) for i in root}


def test_common_part_of_widespread_passages(spark):
    r = random.Random(11)
    passages = [[f"p{k}x{j}" for j in range(20)] for k in range(60)]
    smallest = [int(s[0]) for _, s in J.gram_sets(pa.array([" ".join(p) for p in passages]))]
    passages = [passages[k] for k in sorted(range(60), key=lambda k: -smallest[k])[:10]]  # carriers' own tokens come first
    rows = []
    for k in range(6):  # 180 common trigrams, and 66 of each document's own
        order = r.sample(range(10), 10)
        rows.append((k, " ".join([f"a{k}x{j}" for j in range(48)] + [w for p in order for w in passages[p]])))
    rows += [(100 + k, " ".join(passages[k % 10] + [f"c{k}x{j}" for j in range(14)])) for k in range(7000)]
    want = brute(rows[:6])
    assert [n for *_, n in want] == [5] * 6
    assert got(frame(spark, rows)) == ordered(want + [(i, i, 0) for i, _ in rows[6:]])  # two carriers of a passage are at 0.39, a carrier and a long one under 0.1


def test_hot_tokens_are_independent_of_the_order_of_sketches():
    import numpy as np

    s = np.unique(tk.mix(np.arange(1, 20_001, dtype=tk.U64)))
    _, sample = J.sampled(s, 2000)
    rank = np.searchsorted(s, np.sort(sample)) / len(s)
    assert len(np.unique(sample)) == 2000 and abs(rank.mean() - 0.5) < 0.03


def test_cold_tokens_needed():
    import numpy as np

    r = np.random.default_rng(3)
    limit = J.hot_share(J.T)
    for _ in range(300):
        both, a, b = (np.unique(r.integers(0, 1 << 63, k).astype(tk.U64)) for k in (int(r.integers(30, 400)), int(r.integers(0, 80)), int(r.integers(0, 80))))
        hot = np.sort(r.choice(both, int(r.integers(0, len(both) + 1)), replace=False))
        x, y = np.union1d(both, a), np.union1d(both, b)
        if len(both) / len(np.union1d(x, y)) >= J.T:
            u, v = ({w: (need, set(t.tolist())) for w, need, t in J.sketches(s, hot, J.T)} for s in (x, y))
            assert any(len(u[w][1] & v[w][1]) >= max(u[w][0], v[w][0]) for w in u.keys() & v.keys())
    assert 0 < limit < 55 and J.cold_needed(J.T, limit, 10_000) >= J.LEFT


@pytest.mark.parametrize("k", [20, 100, 180, 200, 220, 340])
def test_pairs_at_the_threshold_itself(k):
    import numpy as np

    s = np.unique(tk.mix(np.arange(1, k + 1, dtype=tk.U64)))
    part = s[: k * 55 // 100]
    rows = {"key": [1, 2], "m": [0, 0], "member": [True, False], "query": [False, True], "dense": [False, False], "copies": [3, 4], "set": [part.tobytes(), s.tobytes()]}
    assert J._compare(J.T)(pa.table(rows)).to_pylist() == [{"key": 1, "links": 4, "root": 1}, {"key": 2, "links": 3, "root": 1}]
    assert J.cold_needed(J.T, 0, k) <= len(part)


def test_pairs_at_the_threshold_itself_open_their_group(spark):
    rows = [(k, " ".join(f"b{k}x{j}" for j in range(m + 2))) for k, m in enumerate((55, 110))] + [(10 + k, " ".join(f"b{k}x{j}" for j in range(n + 2))) for k, n in enumerate((100, 200))]
    assert got(frame(spark, rows)) == brute(rows) and [n for *_, n in brute(rows)] == [1] * 4
