"""Toxic passages as maximal scoring segments of token log-odds.

fit() learns token scores from labelled documents: the log-odds ratio of a token's toxic against its clean document
frequency under a Dirichlet prior proportional to the overall frequency, drawn towards zero by Z standard deviations and
MARGIN (so that words of a language that has more toxic documents score nothing), less a constant drift. Of near copies in the training sample one counts, or their words would look toxic together. Every maximal scoring
segment is found by a linear scan (Ruzzo and Tompa). Karlin and Altschul's extreme-value law turns a segment's score S in a
document of n tokens into an expected count E = K n exp(-lambda S), and the sum of the r best normalised scores into a
probability; a document's p-value is the least over r, each weighted 2**r. lambda solves sum p exp(lambda s) = 1 over the clean
token distribution; K is the maximum-likelihood estimate from clean documents' best segments. A document is toxic if p <= ALPHA.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textkit as tk

#: Labelled rows that fit() uses at most, those whose hashed doc_id is smallest. The bound is on the classifier's training rows only.
TRAIN_ROWS = 20_000
#: PRIOR: weight of the Dirichlet prior as a share of the training rows.
PRIOR, Z, MARGIN, DRIFT, MIN_COUNT, ALPHA = 0.25, 2.5, 0.1, 0.05, 2, 1e-3
#: Training rows are near copies if so many of their SKETCH smallest 5-gram hashes are equal.
SKETCH, COPY = 12, 3

SCHEMA = "doc_id bigint, n_tokens bigint, max_score double, p_value double, toxic boolean, passages array<struct<start:bigint,end:bigint,score:double,e_value:double>>"


@dataclass
class Model:
    """hashes (ascending) and their scores; other tokens score -drift."""

    hashes: np.ndarray
    scores: np.ndarray
    drift: float
    lam: float
    k: float
    alpha: float = ALPHA


def segments(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, by Ruzzo and Tompa's scan. low and high: the cumulative score before and after each positive token. Gives (first positive, last positive, score).

    link has, for each candidate kept, the nearest one before it that starts lower; what lies between starts no lower and need never be looked at again, so the work is linear.
    """
    kept: list[tuple[int, int, float, float]] = []
    link: list[int] = []
    for i, (lo, hi) in enumerate(zip(low.tolist(), high.tolist())):
        first, j = i, len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= lo:
                j = link[j]
            if j < 0 or kept[j][3] >= hi:
                break
            first, lo, before = kept[j][0], kept[j][2], link[j]
            del kept[j:], link[j:]
            j = before
        kept.append((first, i, lo, hi))
        link.append(j)
    return [(a, b, h - l) for a, b, l, h in kept]


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, prior: float = PRIOR, z: float = Z, margin: float = MARGIN) -> np.ndarray:
    """Log ratios of the odds to meet a token in toxic and in clean documents, counts under a Dirichlet prior in proportion to the overall frequency, drawn towards zero by z standard deviations and a margin."""
    if not len(toxic):
        return np.zeros(0)
    a = prior * (toxic + clean)
    t, c = toxic + a, clean + a
    more = prior * (n_toxic + n_clean)
    d = np.log(t / (n_toxic + more)) - np.log(c / (n_clean + more))
    sd = np.sqrt(1 / t + 1 / c)
    return np.sign(d) * np.maximum(0, np.abs(d) - z * sd - margin)


def solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; inf where no score is positive."""
    if not (s > 0).any():
        return float("inf")
    g = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    lo, hi = 1e-6, 1.0
    while g(hi) < 0 and hi < 1e6:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if g(mid) < 0 else (lo, mid)
    return lo


def look_up(h: np.ndarray, keys: np.ndarray, values: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(h), other)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], other)


def _scan(texts: pa.Array, m: Model):
    """(row, tokens, segments as (first token, end token, score)) of every row."""
    for i, j, buf, offs in tk.lower_chunks(texts):
        _, _, first, h = tk.tokens(buf, offs)
        s = look_up(h, m.hashes, m.scores, -m.drift)
        c = np.zeros(len(s) + 1)
        np.cumsum(s, out=c[1:])
        pos = np.flatnonzero(s > 0)
        at = np.searchsorted(pos, first)
        for r in range(j - i):
            p = pos[at[r] : at[r + 1]]
            segs = [(int(p[a] - first[r]), int(p[b] - first[r]) + 1, x) for a, b, x in segments(c[p], c[p + 1])] if len(p) else []
            yield i + r, int(first[r + 1] - first[r]), segs


def _sketches(batches):
    for b in batches:
        ids, out = b.column("doc_id"), []
        for i, j, buf, offs in tk.lower_chunks(b.column("text")):
            _, _, first, h = tk.tokens(buf, offs)
            g = tk.Grams(h).of(5)
            out += [np.unique(g[first[r] : max(first[r], first[r + 1] - 4)])[:SKETCH].view(np.int64) for r in range(j - i)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.list_(pa.int64()))], ["doc_id", "s"])


def copies(sketches: dict[int, list[int]]) -> set[int]:
    """Ids that are near copies, directly or through others, of one that stays."""
    at: dict[int, list[int]] = {}
    root = {i: i for i in sketches}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i in sorted(sketches):
        seen: dict[int, int] = {}
        for h in sketches[i]:
            for j in at.setdefault(h, []):
                seen[j] = seen.get(j, 0) + 1
        for j, n in seen.items():
            if n >= COPY:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for h in sketches[i]:
            at[h].append(i)
    return {i for i in sketches if find(i) != i}


def _counts(batches):
    """Document frequencies and clean occurrences of tokens."""
    for b in batches:
        toxic = tk.column(b, "toxic").astype(bool)
        for i, j, buf, offs in tk.lower_chunks(b.column("text")):
            _, _, first, h = tk.tokens(buf, offs)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            keys, inv = np.unique(h, return_inverse=True)
            bad = toxic[i:j]
            occurs = np.bincount(inv, ~bad[doc], len(keys))
            at = np.unique(inv.astype(np.int64) * (j - i) + doc)
            k, d = at // (j - i), at % (j - i)
            t = np.bincount(k, bad[d], len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"h": tk.signed(keys), "t": t, "c": np.bincount(k, minlength=len(keys)) - t, "n": occurs.astype(np.int64)})


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, min_count: int = MIN_COUNT, drift: float = DRIFT, alpha: float = ALPHA) -> Model:
    """Learns from at most train_rows labelled rows with text. Rows without doc_id, text or label are left out; of several labels of an id the toxic one counts; without labels of both kinds nothing is toxic."""
    spark = docs.sparkSession
    nothing = Model(np.zeros(0, tk.U64), np.zeros(0), drift, float("inf"), 1.0, alpha)
    ids = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = [(r[0], r[1]) for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).collect()]
    if not ids:
        return nothing
    sample = F.broadcast(spark.createDataFrame(ids, "__id bigint, toxic int"))  # train_rows bounds its size
    rows = tk.texts_of(docs).where("text is not null")
    rows = tk.checkpointed(rows.join(sample, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "toxic"))
    drop = copies({r[0]: r[1] for r in rows.mapInArrow(_sketches, "doc_id bigint, s array<bigint>").collect()})
    own = F.broadcast(spark.createDataFrame([(i,) for i in sorted(drop)], "doc_id bigint"))
    rows = rows.join(own, "doc_id", "left_anti").select("text", "toxic")
    n_toxic, n_all = rows.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    if not 0 < n_toxic < n_all:
        return nothing
    n = rows.mapInArrow(_counts, "h bigint, t bigint, c bigint, n bigint").groupBy("h").agg(*(F.sum(x).alias(x) for x in "tcn"))
    got = n.where(F.col("t") + F.col("c") >= min_count).toArrow()
    order = np.argsort(tk.unsigned(tk.column(got, "h")))
    h = tk.unsigned(tk.column(got, "h"))[order]
    t, c, occurs = (tk.column(got, x)[order].astype(float) for x in "tcn")
    s = log_odds(t, c, n_toxic, n_all - n_toxic)
    p = occurs + PRIOR * (t + c)
    p = p / max(1.0, p.sum())
    lam = solve_lambda(p, s - drift)
    keep = np.abs(s) > 1e-9
    m = Model(h[keep], s[keep] - drift, drift, lam, 1.0, alpha)
    if np.isinf(lam):
        return m

    def best(batches):
        for b in batches:
            x = [(n, max([s for *_, s in segs], default=0.0)) for _, n, segs in _scan(b.column("text"), m)]
            yield pa.RecordBatch.from_pydict({"w": pa.array([n * float(np.exp(-lam * s)) for n, s in x], pa.float64())})

    mean = rows.where("toxic = 0").mapInArrow(best, "w double").agg(F.avg("w")).first()[0]
    m.k = 1.0 / max(1e-9, mean or 1.0)
    return m


def p_value(scores: list[float], n: int, m: Model) -> float:
    """Chance of segments as good in n clean tokens: least over r of 2**r P(sum of the r best)."""
    p, total = 1.0, 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        x = m.lam * s - math.log(m.k * n)
        total += x
        if r == 1:
            p = min(1.0, -2 * math.expm1(-math.exp(min(-x, 50.0))))
        elif x <= 0:
            break
        elif total >= r * (r - 1):
            p = min(p, math.exp(min(0.0, r * math.log(2) - total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r))))
    return p


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (SCHEMA). Null and empty texts have no tokens, score 0, p 1 and aren't toxic; repeated rows come as often as they are there; other columns are ignored. passages: the significant segments, by place, as token numbers."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_verdicts(b.column("text"), m.value)], schema=_arrow())

    return tk.texts_of(docs).mapInArrow(run, SCHEMA)


def _arrow() -> pa.Schema:
    seg = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
    return pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("max_score", pa.float64()), ("p_value", pa.float64()), ("toxic", pa.bool_()), ("passages", seg)])


def _verdicts(texts: pa.Array, m: Model) -> list[pa.Array]:
    ns, best, ps, passages = [], [], [], []
    for _, n, segs in _scan(texts, m):
        top = max([s for *_, s in segs], default=0.0)
        e = lambda s: m.k * n * math.exp(-m.lam * s)
        p = p_value([s for *_, s in segs], n, m) if segs else 1.0
        ns.append(n), best.append(round(top, 6)), ps.append(p)
        passages.append([{"start": a, "end": b, "score": round(s, 6), "e_value": e(s)} for a, b, s in segs if -math.expm1(-e(s)) <= m.alpha])
    f = _arrow()
    return [pa.array(ns, pa.int64()), pa.array(best, pa.float64()), pa.array(ps, pa.float64()), pa.array([p <= m.alpha for p in ps], pa.bool_()), pa.array(passages, f.field("passages").type)]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, tk.table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the toxic ones; every column stays. Filtering happens where the row is read: no join, no shuffle."""
    tk.small_batches(spark)
    m = spark.sparkContext.broadcast(fit(docs, tk.table(spark, sf_dir, "labels")))

    def run(batches):
        for b in batches:
            toxic = _verdicts(b.column("text"), m.value)[3]
            yield b.filter(pa.compute.invert(toxic))

    return docs.mapInArrow(run, docs.schema)
