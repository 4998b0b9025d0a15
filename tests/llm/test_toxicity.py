import math
import random
import time

import numpy as np
import pytest

from parcelflow.llm import toxicity as X


def maximal(s: list[float]) -> list[tuple[int, int]]:
    """By definition: the best segment, then the same left and right of it."""

    def go(a: int, b: int):
        best = max(((sum(s[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0, 0))
        if best[0] <= 1e-12:
            return []
        return go(a, best[2]) + [(best[2], best[3])] + go(best[3], b)

    return go(0, len(s))


def scan(s: list[float]) -> list[tuple[int, int]]:
    c = np.concatenate([[0], np.cumsum(s)])
    pos = np.flatnonzero(np.array(s) > 0)
    return [(int(pos[a]), int(pos[b]) + 1) for a, b, _ in X.segments(c[pos], c[pos + 1])]


def test_segments_are_all_maximal_ones():
    r = random.Random(1)
    for _ in range(200):
        s = [r.uniform(-1, 1) for _ in range(r.randrange(0, 14))]
        assert scan(s) == maximal(s)


def test_time_is_linear():
    def took(n: int, step: float) -> float:
        low = np.arange(n) * step
        start = time.perf_counter()
        assert len(X.segments(low, low + 0.5)) >= 1
        return time.perf_counter() - start

    for step in (-1.0, 0.25, 1e-9):  # each positive token starts lower than the one before; or higher; or all join
        small = min(took(20_000, step) for _ in range(3))
        assert min(took(80_000, step) for _ in range(3)) < 6 * small + 0.01


def test_lambda_solves_its_equation():
    p, s = np.array([0.9, 0.1]), np.array([-0.5, 2.0])
    lam = X.solve_lambda(p, s)
    assert abs((p * np.exp(lam * s)).sum() - 1) < 1e-6 and lam > 0.01
    assert math.isinf(X.solve_lambda(p, np.array([-1.0, -1.0])))


def docs_and_labels(spark, n=400):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{r.randrange(300)}" for _ in range(120)]
        bad = i % 5 == 0
        if bad:
            for k in r.sample(range(40, 80), 6):
                w[k] = r.choice(["foul", "vile", "nasty"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_documents(spark):
    docs, labels = docs_and_labels(spark)
    got = {r["doc_id"]: r for r in X.score(docs, X.fit(docs, labels)).collect()}
    held = [i for i in got if i % 2]
    assert all(got[i]["toxic"] == (i % 5 == 0) for i in held)
    for i in held:
        if i % 5 == 0:
            assert got[i]["passages"] and all(30 <= p["start"] < p["end"] <= 90 for p in got[i]["passages"])


def test_odd_rows_and_empty_tables(spark, odd, empty):
    docs, labels = docs_and_labels(spark, 100)
    m = X.fit(docs, labels)
    got = X.score(odd, m).collect()
    assert len(got) == odd.count() and not any(r["toxic"] for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (4, 5, 6)} == {0}
    assert X.score(empty, m).count() == 0
    none = X.fit(odd, spark.createDataFrame([(None, 1), (3, None)], "doc_id bigint, toxic int"))
    assert not any(r["toxic"] for r in X.score(docs, none).collect())
    assert not len(X.fit(empty, labels).hashes)


def test_near_copies_count_once():
    a = list(range(12))
    assert X.copies({1: a, 2: a[:3] + [90, 91], 3: [90, 91, 92], 4: a[:2]}) == {2}


def test_no_positive_scores_mean_no_p_value():
    m = X.Model(np.zeros(0, np.uint64), np.zeros(0), 0.05, float("inf"), 1.0)
    assert X.look_up(np.array([1, 2], np.uint64), m.hashes, m.scores, -0.05).tolist() == [-0.05, -0.05]


@pytest.mark.parametrize("n", [1, 3])
def test_more_evidence_is_less_likely(n):
    m = X.Model(np.zeros(0, np.uint64), np.zeros(0), 0.05, 1.0, 0.01)
    assert X.p_value([9.0] * n, 100, m) > X.p_value([9.0] * (n + 1), 100, m) * 0.999
