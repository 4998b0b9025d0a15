"""Benchmark decontamination: item-sized windows, SimHash, multi-index Hamming blocks, exact verification.

An item's features are its word bigrams, weighted by inverse item frequency; a window has as many words as the item, and a row
of fewer words is one window as a whole. Its
similarity is the weighted Jaccard of the two bigram multisets. The steps:
1. Windows that can't reach T fall out exactly: a window's bigrams that stand in the benchmark at all must weigh at least T
   times what the lightest item of that size weighs. A running sum tells it, for classes of sizes first (the largest window of
   the class against the least threshold), then for the sizes of what is left. In a run of one repeated word only the first
   bigram counts (unless an item has such a run); a window may start inside the run, so thresholds give way by that bigram's weight.
2. The others get a SimHash of BITS bits, in BLOCKS blocks. Fingerprints within RADIUS agree in some block up to
RADIUS // BLOCKS bits, so every item of the window's size within RADIUS is among those that do: of unlike items about one in
25. The index holds the items' blocks by size as arrays, and a window's blocks are compared with all of them at once;
listing the values within 9 bits of a 32-bit block would take far more entries than there are items. At a similarity of T
itself about 29 bits differ, with a deviation of 5: 97 of 100 such windows are within RADIUS, and of closer ones more.
3. Of these, windows of similarity T or more are reported, for each document and item the best one.
Documents are only read; the benchmark's index is broadcast after a check of its size, and beyond MOST_WORDS words the items are
taken in several passes.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textkit as tk

T, BITS, BLOCKS, RADIUS = 0.6, 128, 4, 39
#: Words that one running sum of signed weights covers at most, beyond its first window.
SPAN = 4096
#: Benchmark words that go into one broadcast index.
MOST_WORDS = 2_000_000

SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, similarity double, hamming int"


def signs(features: np.ndarray) -> np.ndarray:
    """+1/-1 for each bit of the features' hashes: rows x BITS, float32."""
    parts = [tk.mix(features ^ tk.U64(0xA5A5A5A5A5A5A5A5 + k)) for k in range(BITS // 64)]
    raw = np.ascontiguousarray(np.stack(parts, 1)).view(np.uint8)
    return np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints (rows x BLOCKS) of signed bit sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.dtype(f"u{BITS // BLOCKS // 8}"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ, of each pair of fingerprints and each block."""
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :])


@dataclass
class Index:
    """weights: of the benchmark's bigrams, by ascending hash; twice: which of them an item has twice; least: the lightest item of each number of words; blocks: size -> (items, their fingerprints)."""

    keys: np.ndarray
    weights: np.ndarray
    twice: np.ndarray
    items: list[tuple[int, int, dict[int, int], float, np.ndarray]] = field(default_factory=list)  # id, words, bigram counts, weight, fingerprint
    least: dict[int, float] = field(default_factory=dict)
    blocks: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def weigh(self, f: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.keys, f), len(self.keys) - 1)
        return np.where(self.keys[k] == f, self.weights[k], other_weight(self))


def _bigrams(texts: pa.Array):
    """(row, words, bigram hashes) of every row; a row of one word has that word as its only feature, and none if it has no word."""
    for i, j, buf, offs in tk.lower_chunks(texts):
        _, _, first, h = tk.tokens(buf, offs)
        g = tk.Grams(h)
        two, one = g.of(2), g.of(1)
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            yield i + r, b - a, two[a : b - 1] if b - a > 1 else one[a:b]


def build(items: list[tuple[int, str]], df: Counter | None = None, total: int | None = None) -> Index:
    """Index of (item_id, text); items without words are left out. df, total: bigram frequencies over all items, if these are a part."""
    got = [(items[r][0], n, f) for r, n, f in _bigrams(pa.array([t for _, t in items], pa.string())) if n]
    df = df if df is not None else Counter(x for *_, f in got for x in np.unique(f).tolist())
    total = total if total is not None else len(got)
    keys = np.unique(np.concatenate([f for *_, f in got])) if got else np.zeros(0, tk.U64)
    w = np.array([math.log(1 + total / df[x]) for x in keys.tolist()], np.float64)
    repeated = [x for *_, f in got for x, n in Counter(f.tolist()).items() if n > 1]
    ix = Index(keys, w, np.isin(keys, np.array(repeated, tk.U64)))
    for item, n, f in got:
        fw = w[np.searchsorted(keys, f)]
        fp = packed((signs(f) * fw[:, None].astype(np.float32)).sum(0, keepdims=True))[0]
        ix.items.append((item, n, dict(Counter(f.tolist())), float(fw.sum()), fp))
        ix.least[n] = min(ix.least.get(n, math.inf), float(fw.sum()))
    for n in ix.least:
        at = [k for k, x in enumerate(ix.items) if x[1] == n]
        ix.blocks[n] = np.array(at), np.stack([ix.items[k][4] for k in at])
    return ix


def similarity(window: Counter, w: dict[int, float] | None, item: dict[int, int], weight_of) -> float:
    """Weighted Jaccard of two multisets of bigrams."""
    lo = sum(weight_of(f) * min(n, window.get(f, 0)) for f, n in item.items())
    hi = sum(weight_of(f) * max(n, item.get(f, 0)) for f, n in window.items()) + sum(weight_of(f) * n for f, n in item.items() if f not in window)
    return lo / hi if hi else 0.0


def size_classes(ix: Index, t: float) -> list[tuple[int, float, list[int]]]:
    """(largest size, least threshold, sizes) of classes of similar sizes from two words on."""
    out: list[list[int]] = []
    for n in sorted(x for x in ix.least if x > 1):
        if out and n <= 1.3 * out[-1][0]:
            out[-1].append(n)
        else:
            out.append([n])
    return [(c[-1], min(t * ix.least[n] for n in c), c) for c in out]


def other_weight(ix: Index) -> float:
    """Weight of a bigram that no item has: the largest, as of one that a single item has."""
    return float(ix.weights.max()) if len(ix.weights) else 1.0


def scan(texts: pa.Array, ix: Index, t: float = T, radius: int = RADIUS):
    """(row, item, start, end, similarity, hamming): the best window of each row and item; of equal ones the first."""
    if not ix.items:
        return
    sizes = sorted(ix.least)
    classes = size_classes(ix, t)
    rest = other_weight(ix)
    weight = dict(zip(ix.keys.tolist(), ix.weights.tolist()))
    weight_of = lambda f: weight.get(f, rest)
    table = np.zeros(1 << 16, bool)
    table[(ix.keys >> tk.U64(48)).astype(np.int64)] = True
    for i, j, buf, offs in tk.lower_chunks(texts):
        _, _, first, h = tk.tokens(buf, offs)
        grams = tk.Grams(h)
        two = grams.of(2)
        if 1 in ix.least:
            yield from _single(i, first, grams.of(1), ix)
        if not len(two):
            continue
        w = np.zeros(len(two))
        at = np.flatnonzero(table[(two >> tk.U64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(ix.keys, two[at]), len(ix.keys) - 1)
        w[at] = np.where(ix.keys[k] == two[at], ix.weights[k], 0.0)
        once = np.zeros(len(two), bool)
        once[at] = ~ix.twice[k]
        last = first[1:] - 1
        w[last[(last >= 0) & (last < len(w))]] = 0.0  # bigrams across rows
        again = np.flatnonzero(two[1:] == two[:-1]) + 1
        w[again[once[again]]] = 0.0
        c = np.concatenate([[0.0], np.cumsum(w)])
        c = np.concatenate([c, np.full(sizes[-1], c[-1])])
        found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        slack = rest + 1e-6
        for r, x, e, n in _short(first, c, ix, t, slack):
            found[r].append((n, x, e))
        for top, least, members in classes:
            s = np.flatnonzero(c[top - 1 : top - 1 + len(h)] - c[: len(h)] >= least - slack)
            if not len(s):
                continue
            row = np.searchsorted(first, s, "right") - 1
            end = first[row + 1]
            for n in members:
                ok = (c[s + n - 1] - c[s] >= t * ix.least[n] - slack) & (s + n <= end)
                for r, x in zip(row[ok].tolist(), s[ok].tolist()):
                    found[r].append((n, x, x + n))
        for r, windows in found.items():
            best: dict[int, tuple[float, int, int, int]] = {}
            for n, x, e, k, d in _near(windows, two, ix, radius):
                item, _, counts, _, _ = ix.items[k]
                sim = similarity(Counter(two[x : e - 1].tolist()), None, counts, weight_of)
                if sim >= t - 1e-12 and (item not in best or (-sim, x) < (-best[item][0], best[item][1])):
                    best[item] = (sim, x, e, d)
            for item, (sim, x, e, d) in sorted(best.items()):
                yield i + r, item, x - int(first[r]), e - int(first[r]), round(sim, 6), d


def _short(first: np.ndarray, c: np.ndarray, ix: Index, t: float, slack: float):
    """(row, start, end, item size) of rows with fewer words than items of that size, and weight enough. c: running sum of weights."""
    sizes = np.array(sorted(ix.least))
    least = t * np.array([ix.least[n] for n in sizes.tolist()]) - slack
    words = np.diff(first)
    longer = np.searchsorted(sizes, words, "right")
    lowest = np.append(np.minimum.accumulate(least[::-1])[::-1], math.inf)
    weight = c[np.maximum(first[1:] - 1, first[:-1])] - c[first[:-1]]
    for r in np.flatnonzero((words > 1) & (weight >= lowest[longer])).tolist():
        for k in range(int(longer[r]), len(sizes)):
            if weight[r] >= least[k]:
                yield r, int(first[r]), int(first[r + 1]), int(sizes[k])


def _single(i: int, first: np.ndarray, one: np.ndarray, ix: Index):
    """Items of one word: the windows are the words."""
    own: dict[int, set[int]] = defaultdict(set)
    for item, n, c, _, _ in ix.items:
        if n == 1:
            own[next(iter(c))].add(item)
    for r in range(len(first) - 1):
        f = one[first[r] : first[r + 1]].tolist()
        for g, items in own.items():
            if g in f:
                for item in sorted(items):
                    yield i + r, item, f.index(g), f.index(g) + 1, 1.0, 0


def _near(windows: list[tuple[int, int, int]], two: np.ndarray, ix: Index, radius: int):
    """(size, start, end, item, distance) of the items within the radius of windows (item size, start, end)."""
    for own, fps in _fingerprints(windows, two, ix):
        size = np.array([n for n, _, _ in own])
        for n in np.unique(size).tolist():
            at, (items, blocks) = np.flatnonzero(size == n), ix.blocks[n]
            for a in range(0, len(at), step := max(1, 2_000_000 // (BLOCKS * len(items)))):
                d = distances(fps[at[a : a + step]], blocks)
                w, k = np.nonzero((d <= radius // BLOCKS).any(2))
                total = d[w, k].sum(1)
                for x, y, z in zip(w[total <= radius].tolist(), k[total <= radius].tolist(), total[total <= radius].tolist()):
                    yield *own[at[a + x]], int(items[y]), z


def _fingerprints(windows: list[tuple[int, int, int]], two: np.ndarray, ix: Index):
    """(windows, fingerprints) of windows (item size, start, end); those that are close share one running sum of signed weights."""
    windows = sorted(windows, key=lambda x: x[1])
    a = 0
    while a < len(windows):
        b, s0, end = a, windows[a][1], windows[a][2]
        while b < len(windows) and windows[b][1] <= end and windows[b][2] - s0 < SPAN + windows[a][2] - s0:
            end = max(end, windows[b][2])
            b += 1
        f = two[s0 : end - 1]
        c = np.zeros((len(f) + 1, BITS))
        np.cumsum(signs(f) * ix.weigh(f)[:, None], axis=0, out=c[1:])
        s, e = np.array([x[1] for x in windows[a:b]]) - s0, np.array([x[2] for x in windows[a:b]]) - s0
        yield windows[a:b], packed(c[e - 1] - c[s] - 1e-9)
        a = b


def indexes(benchmark: DataFrame, most_words: int = MOST_WORDS) -> list[Index]:
    """The benchmark's index, in parts of at most about most_words words. Rows without item_id or text are left out; of equal ids all texts count."""
    parts: list[list[tuple[int, str]]] = [[]]
    words = 0
    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id is not null and text is not null").orderBy("item_id", "text")
    everything = []
    for r in rows.toLocalIterator():
        n = len(r[1].split()) + 1
        if words + n > most_words and parts[-1]:
            parts.append([])
            words = 0
        parts[-1].append((r[0], r[1]))
        words += n
        everything.append(r[1])
    df: Counter = Counter()
    total = 0
    for _, n, f in _bigrams(pa.array(everything, pa.string())):
        if n:
            total += 1
            df.update(np.unique(f).tolist())
    return [build(p, df, total) for p in parts]


def contaminated(docs: DataFrame, benchmark: DataFrame, t: float = T, radius: int = RADIUS) -> DataFrame:
    """SCHEMA: the best window of each row of docs and item with similarity t or more; start and end in words, all of a row that has fewer than the item. Null and empty texts have none; repeated rows are reported as often; null ids stay null; an empty benchmark gives no rows; other columns are ignored."""
    sc = docs.sparkSession.sparkContext
    parts = [sc.broadcast(ix) for ix in indexes(benchmark)]
    rows = tk.texts_of(docs)

    def run_with(b):
        def run(batches):
            for x in batches:
                ids = x.column("doc_id").to_pylist()
                out = [(ids[r], item, a, e, s, d) for r, item, a, e, s, d in scan(x.column("text"), b.value, t, radius)]
                yield pa.RecordBatch.from_arrays([pa.array([y[c] for y in out], f.type) for c, f in enumerate(ARROW)], schema=ARROW)

        return run

    df = rows.mapInArrow(run_with(parts[0]), SCHEMA)
    for b in parts[1:]:
        df = df.unionByName(rows.mapInArrow(run_with(b), SCHEMA))
    return df


ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64()), ("hamming", pa.int32())])


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(tk.table(spark, sf_dir, "documents"), tk.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold an item. Rows are filtered where they are read: no join."""
    tk.small_batches(spark)
    out = docs
    for ix in indexes(tk.table(spark, sf_dir, "benchmark")):
        out = out.mapInArrow(_dropping(spark.sparkContext.broadcast(ix)), docs.schema)
    return out


def _dropping(ix):
    def run(batches):
        for b in batches:
            hit = np.zeros(b.num_rows, bool)
            for r, *_ in scan(b.column("text"), ix.value):
                hit[r] = True
            yield b.filter(pa.array(~hit))

    return run
