"""Repeated passages: suffixes ordered only through LENGTH tokens, by most-significant-digit radix passes.

The most significant digit of a suffix is the smallest of the hashes of half of LENGTH tokens within its first LENGTH tokens (its
anchor), with the anchor's place; the other digit is the hash of all LENGTH tokens. Two passes thus order the suffixes through
LENGTH tokens (by hashes, not by the alphabet), and groups of equal digits are exactly the windows that repeat. A suffix alone in
its group falls out after each pass.

Neighbouring suffixes mostly have one anchor (about one in LENGTH / 4 positions is one), and such a run travels as one row with a
hash for each of its suffixes. The first pass needs anchors alone: they are counted over the corpus, and texts meet the places of
those that occur twice, so suffixes that are alone are never shuffled. The second pass orders the suffixes behind an anchor. Anchors with over HOT rows are
not brought together: their suffixes are counted by hash of the whole window, with partial sums before the shuffle, and joined with their counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textkit as tk

LENGTH = 50
#: Runs behind one anchor that one task orders at most.
HOT = 250_000

SCHEMA = "doc_id bigint, start bigint, end bigint, copies bigint, first_doc_id bigint, first_start bigint, later boolean"


def first_least(x: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values, the position of the first of the least, by doubling."""
    at, value, have = np.arange(len(x)), x, 1
    while have < w:
        step = min(have, w - have)
        n = len(value) - step
        later = value[step:] < value[:n]
        at, value = np.where(later, at[step:], at[:n]), np.where(later, value[step:], value[:n])
        have += step
    return at


def anchors(h: np.ndarray, first: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of `length` tokens inside one row, their anchors' positions, and the digits at every position."""
    half = length // 2
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, tk.U64)
    g = tk.Grams(h).of(half)
    at = first_least(g, length - half + 1)
    row_end = np.repeat(first[1:], np.diff(first))
    inside = np.flatnonzero(np.arange(len(at)) + length <= row_end[: len(at)])
    return inside, at[inside], g


def _input(docs: DataFrame) -> DataFrame:
    return tk.texts_of(docs).where("doc_id is not null and text is not null")


def _anchors(length: int):
    def run(batches):
        for b in batches:
            ids = tk.column(b, "doc_id")
            for i, j, buf, offs in tk.lower_chunks(b.column("text")):
                _, _, first, h = tk.tokens(buf, offs)
                _, at, g = anchors(h, first, length)
                at = np.unique(at)
                row = np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([g[at].view(np.int64), ids[i + row], (at - first[row]).astype(np.int32)], ["digit", "doc_id", "pos"])

    return run


RUNS = "digit bigint, hot boolean, doc_id bigint, pos int, place int, rest binary"


def _runs(length: int):
    """RUNS of neighbouring windows that have one anchor, of those in the column `at`; pos: the first one's, place: the anchor's place in it, rest: the windows' hashes."""

    def run(batches):
        for b in batches:
            ids, lists = tk.column(b, "doc_id"), b.column("at")
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            flat = lists.flatten()
            pos, hot = flat.field("pos").to_numpy(), flat.field("hot").is_valid().to_numpy(zero_copy_only=False)
            hot_digit = flat.field("hot").fill_null(0).to_numpy().view(tk.U64)
            for i, j, buf, offs in tk.lower_chunks(b.column("text")):
                _, _, first, h = tk.tokens(buf, offs)
                p, at, g = anchors(h, first, length)
                if not len(p):
                    continue
                met = slice(ends[i], ends[j])
                there = np.repeat(first[:-1], np.diff(ends[i : j + 1])) + pos[met]
                kind = np.zeros(len(h) + 1, np.int8)  # 1: shared, 2: hot
                ok = there < len(g)  # an id's other text may be longer
                kind[there[ok & ~hot[met]]] = 1
                ok[ok] &= ~hot[met][ok] | (g[there[ok]] == hot_digit[met][ok])
                kind[there[ok & hot[met]]] = 2
                some = kind[at] > 0
                p, at = p[some], at[some]
                if not len(p):
                    continue
                new = np.flatnonzero(np.append(True, (p[1:] != p[:-1] + 1) | (at[1:] != at[:-1])))
                whole = tk.Grams(h).of(length)[p]
                row = np.searchsorted(first, p[new], "right") - 1
                rest = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer((np.append(new, len(p)) * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(whole))])
                cols = [g[at[new]].view(np.int64), pa.array(kind[at[new]] == 2), ids[i + row], (p[new] - first[row]).astype(np.int32), (at[new] - p[new]).astype(np.int32), rest]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["digit", "hot", "doc_id", "pos", "place", "rest"])

    return run


def _table(batches) -> pa.Table | None:
    b = [x for x in batches if x.num_rows]
    return pa.Table.from_batches(b) if b else None


def _suffixes(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """digit, place, rest, doc_id, pos of every suffix of the runs."""
    rest = t.column("rest")
    n = pa.compute.binary_length(rest).to_numpy().astype(np.int64) // 8
    own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    raw = np.frombuffer(b"".join(rest.to_pylist()), np.int64)
    digit, doc, pos, place = (np.repeat(tk.column(t, x), n) for x in ("digit", "doc_id", "pos", "place"))
    return digit, place - own, raw, doc, pos + own


def _exploded(batches):
    for b in batches:
        digit, place, rest, doc, pos = _suffixes(b)
        yield from pa.table([digit, place.astype(np.int32), rest, doc, pos.astype(np.int32)], ["digit", "place", "rest", "doc_id", "pos"]).to_batches(1 << 16)


MERGED = "doc_id bigint, pos int, n int, copies bigint, first_doc_id bigint, first_pos int"


def _equal(batches):
    """Radix passes over one partition of anchors: MERGED windows that repeat, with their group's size and first member."""
    t = _table(batches)
    if t is None:
        return
    digit, place, rest, doc, pos = _suffixes(t)
    o = np.lexsort((pos, doc, rest, place, digit))
    digit, place, rest, doc, pos = digit[o], place[o], rest[o], doc[o], pos[o]
    group = np.append(True, (digit[1:] != digit[:-1]) | (place[1:] != place[:-1]) | (rest[1:] != rest[:-1]))
    once = group | np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))  # not a row that repeats
    doc, pos, group = doc[once], pos[once], group[once]
    edge = np.flatnonzero(group)
    size = np.diff(np.append(edge, len(doc)))
    head, n = np.repeat(edge, size), np.repeat(size, size)
    keep = n > 1
    yield from _merged(doc[keep], pos[keep], np.ones(keep.sum(), np.int64), n[keep], doc[head][keep], pos[head][keep])


def _merged(doc, pos, size, n, fd, fp):
    """MERGED rows: neighbours in place that have the same group size and whose first members are neighbours too become one."""
    o = np.lexsort((pos, doc))
    doc, pos, size, n, fd, fp = (x[o] for x in (doc, pos, size, n, fd, fp))
    a = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + size[:-1]) | (n[1:] != n[:-1]) | (fd[1:] != fd[:-1]) | (fp[1:] != fp[:-1] + size[:-1]))[: len(doc)])
    total = np.add.reduceat(size, a) if len(a) else size
    yield from pa.table([doc[a], pos[a].astype(np.int32), total.astype(np.int32), n[a].astype(np.int64), fd[a], fp[a].astype(np.int32)], ["doc_id", "pos", "n", "copies", "first_doc_id", "first_pos"]).to_batches(1 << 16)


def _merging(batches):
    for b in batches:
        yield from _merged(*(tk.column(b, x).astype(np.int64) for x in ("doc_id", "pos", "n", "copies", "first_doc_id", "first_pos")))


def _passages(length: int):
    """Of whole documents."""

    def run(batches):
        t = _table(batches)
        if t is None:
            return
        for b in _merged(*(tk.column(t, x).astype(np.int64) for x in ("doc_id", "pos", "n", "copies", "first_doc_id", "first_pos"))):
            doc, pos, n, copies, fd, fp = (tk.column(b, x) for x in ("doc_id", "pos", "n", "copies", "first_doc_id", "first_pos"))
            start = pos.astype(np.int64)
            cols = [doc, start, start + n + length - 1, copies, fd, fp.astype(np.int64), pa.array((doc != fd) | (pos != fp))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "end", "copies", "first_doc_id", "first_start", "later"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """SCHEMA: the passages of `length` tokens or more that occur twice or more, in one document or in several.

    A row is a maximal run of repeated windows [start, end) (in tokens) of one document that have the same number of
    copies and whose first occurrences (by doc_id, then place) are a run too; later: it isn't that first occurrence, so
    removing later passages leaves each passage once. Rows without doc_id or text, and texts under `length` tokens, have
    none; rows that repeat an id and a text count once, another text of an id counts as more windows at its places; other columns are ignored.
    """
    rows = _input(docs)
    marked = rows.mapInArrow(_anchors(length), "digit bigint, doc_id bigint, pos int")
    counts = marked.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = tk.checkpointed(counts.select("digit", (F.col("n") > HOT).alias("hot")))
    lists = marked.join(counts, "digit").groupBy("doc_id").agg(F.collect_set(F.struct("pos", F.when(F.col("hot"), F.col("digit")).alias("hot"))).alias("at"))
    runs = rows.join(tk.checkpointed(lists), "doc_id").mapInArrow(_runs(length), RUNS)
    if counts.where("hot").isEmpty():
        equal = runs.repartition("digit").mapInArrow(_equal, MERGED)
    else:
        equal = runs.where("not hot").repartition("digit").mapInArrow(_equal, MERGED).union(_hot(runs.where("hot")))
    return equal.repartition("doc_id").mapInArrow(_passages(length), SCHEMA)


def _hot(runs: DataFrame) -> DataFrame:
    """MERGED rows of hot anchors: windows are counted with partial sums, and meet their counts in a join that can be split."""
    each = tk.checkpointed(runs.mapInArrow(_exploded, "digit bigint, place int, rest bigint, doc_id bigint, pos int").distinct())
    same = ["digit", "place", "rest"]
    first = F.min(F.struct("doc_id", "pos"))
    groups = each.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), first.alias("first")).where("copies > 1")
    groups = tk.checkpointed(groups.select(*same, "copies", F.col("first.doc_id").alias("first_doc_id"), F.col("first.pos").alias("first_pos")))
    found = each.join(groups, same).select("doc_id", "pos", F.lit(1).alias("n"), "copies", "first_doc_id", "first_pos")
    return found.mapInArrow(_merging, MERGED)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(tk.table(spark, sf_dir, "documents"))


SQL = rf"""
with w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10ffff}}]+') as ws from documents where doc_id is not null)
, s as (select doc_id, i - 1 as pos, md5(array_to_string(list_slice(ws, i, i + {LENGTH - 1}), ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - {LENGTH - 2})) as i from w where len(ws) >= {LENGTH}))
, g as (select doc_id, pos, count(*) over (partition by h) as copies, first_value(doc_id) over (partition by h order by doc_id, pos) as fd, first_value(pos) over (partition by h order by doc_id, pos) as fp from s)
, r as (select *, case when lag(pos) over q = pos - 1 and lag(copies) over q = copies and lag(fd) over q = fd and lag(fp) over q = fp - 1 then 0 else 1 end as cut from g where copies > 1 window q as (partition by doc_id order by pos))
, p as (select *, sum(cut) over (partition by doc_id order by pos) as k from r)
select doc_id, min(pos)::bigint as start, (max(pos) + {LENGTH})::bigint as "end", min(copies)::bigint as copies, min(fd) as first_doc_id, min(fp)::bigint as first_start, min(doc_id) <> min(fd) or min(pos) <> min(fp) as later from p group by doc_id, k
"""
