"""Near duplicates: an n-gram Jaccard join over a token-group matrix.

A document is the set of its word N-grams (a shorter one is a single n-gram of all its words). Equal sets are joined first:
one of their rows stands for them. The others are parted into groups of similar documents: a document joins the leader, the
smallest key behind a token, with which its sketch shares the most tokens if these are LIKE at least, else it is a group of
its own. A cluster of near copies makes few groups. A group's column of the
matrix is the union of its members' tokens. Two bounds decide which groups a document
opens. (1) Over sketches, the SKETCH smallest tokens of a set in one order for all, a join by token counts the
tokens that a document shares with a group's union; documents at Jaccard p share each of the smallest tokens of their
union with chance p at least, so the binomial law says how many common ones they have but for a chance of MISS. (2) Where document and group meet, the
whole set against the whole union: |Q & U| >= T |Q|, else no member can qualify. Members of opened groups are compared
exactly (64 bits a token), in cells of GROUP members and GROUP queries.

Passages that very many documents share would make candidates of them all. Tokens in samples of over HOT groups are hot, and
step (1) runs twice. Over sketches of the other, cold tokens: of a pair at T of which one document at least has a share of
hot tokens up to f, the cold parts have Jaccard (T - f) / (1 - f) at least, and that says how many tokens they share.
Over sketches of whole sets, for the dense documents, those with more hot tokens than hot_share(T): the pairs of which both are
such, and only there.
Samples go by another hash than the order of sketches. Otherwise hot tokens would be those early in the order, the cold ones
early in it would be seldom shared, and the binomial law would not hold.

The result has one row a document: its class (all that links connect) and its number of links. A cell adds up links and
connects its members, so pairs never leave it. Tokens, classes and groups that hold a large share of all rows meet their
statistics in joins whose other side is a written table of one row a key, which adaptive execution splits.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelflow.llm import textkit as tk

N, T = 3, 0.55
#: 0.55 * 100 is a little over 55: what bounds give way by, so that they pass all that the exact test passes.
EPS = 1e-9
#: A pair at T may be missed with that chance; together with SKETCH it says how many tokens of a sketch a document must share with a group.
SKETCH, MISS = 64, 1e-7
LIKE, HOT = 6, 256
#: Tokens of a set that are counted to find the hot ones.
SAMPLE = SKETCH // 2
#: Of the tokens that a document must share with a group, how many it must share besides its most common ones.
LEFT = 5
#: Hot tokens (8 bytes each) that are broadcast at most; beyond it the least hot are left out, which costs time only.
MOST_HOT = 2_000_000
#: Members and queries (and tokens of either) that meet in one task; larger groups are split.
GROUP, GROUP_TOKENS = 2048, 4_000_000


def gram_sets(texts: pa.Array, n: int = N):
    """(row, sorted distinct n-gram hashes) of the rows that have a token."""
    for i, j, buf, offs in tk.lower_chunks(texts):
        _, _, first, h = tk.tokens(buf, offs)
        g = tk.Grams(h)
        grams = g.of(n)
        f = first.tolist()
        for r in range(j - i):
            a, b = f[r], f[r + 1]
            if b - a >= n:
                yield i + r, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield i + r, g.of(b - a)[a : a + 1]


def _signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = int(s.sum(dtype=tk.U64)), int(tk.mix(s ^ tk.U64(0x5DEECE66D)).sum(dtype=tk.U64))
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def needed(t: float, k: int = SKETCH, miss: float = MISS) -> int:
    """The most tokens that two sketches of k share, but for a chance of `miss`, at Jaccard t."""
    total, c = 0.0, 0
    while True:
        total += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if total > miss:
            return c
        c += 1


def cold_needed(t: float, percent: int, n: int) -> int:
    """The most cold tokens that sketches of two sets of Jaccard t share, one of them of n tokens, if up to so many percent of one of them are hot."""
    f = percent / 100
    return min(_cold_share(t, percent), math.ceil((t - f) * n - EPS))


@functools.cache
def _cold_share(t: float, percent: int) -> int:
    return needed((t - percent / 100) / (1 - percent / 100))


@functools.cache
def hot_share(t: float) -> int:
    """The percentage of hot tokens up to which sketches of cold ones must share LEFT tokens."""
    return max((p for p in range(int(100 * t)) if _cold_share(t, p) >= LEFT), default=0)


def sampled(s: np.ndarray, k: int = SAMPLE) -> tuple[int, np.ndarray]:
    """The smallest of the tokens' second hashes, and the k tokens with the smallest."""
    h = tk.mix(s ^ tk.U64(0x9E6C63D0876A9A62))
    return int(h.min().view(np.int64)), s if len(s) <= k else s[np.argpartition(h, k - 1)[:k]]


def sketches(s: np.ndarray, hot: np.ndarray, t: float, k: int = SKETCH):
    """(whether of the whole set, tokens needed, tokens) of a sorted set's sketches."""
    is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
    cold = s[~is_hot]
    percent = -(-100 * (len(s) - len(cold)) // len(s))
    if len(cold):
        yield False, cold_needed(t, min(percent, hot_share(t)), len(s)), cold[:k]
    if percent > hot_share(t):
        yield True, cold_needed(t, 0, len(s)), s[:k]


def sets_of(rows: DataFrame, n: int = N) -> DataFrame:
    """key, doc_id, sig1, sig2, gid, tokens of every row: the set's signature, smallest second hash and sample; null where there is no id, text or token."""

    def run(batches):
        for b in batches:
            keys, ids = b.column("key").to_pylist(), b.column("doc_id").to_pylist()
            found = {r: (*_signature(s), *sampled(s)) for r, s in gram_sets(b.column("text"), n) if ids[r] is not None}
            out = [(keys[r], ids[r], *(found[r][:3] if r in found else (None,) * 3)) for r in range(b.num_rows)]
            tokens = [found[r][3].view(np.int64) if r in found else np.zeros(0, np.int64) for r in range(b.num_rows)]
            yield _with_tokens(out, tokens, [(x, pa.int64()) for x in ("key", "doc_id", "sig1", "sig2", "gid")])

    return rows.mapInArrow(run, "key bigint, doc_id bigint, sig1 bigint, sig2 bigint, gid bigint, tokens array<bigint>")


def sketches_of(rows: DataFrame, hot, n: int = N, t: float = T) -> DataFrame:
    """key, n, dense, whole, need, tokens: the sketches of rows with an id and a token; n is the set's size. hot: broadcast hot tokens."""

    def run(batches):
        for b in batches:
            keys, out, tokens = tk.column(b, "key"), [], []
            for r, s in gram_sets(b.column("text"), n):
                each = list(sketches(s, hot.value, t))
                for whole, need, sketch in each:
                    out.append((keys[r], len(s), each[-1][0], whole, need))
                    tokens.append(sketch.view(np.int64))
            yield _with_tokens(out, tokens, [("key", pa.int64()), ("n", pa.int64()), ("dense", pa.bool_()), ("whole", pa.bool_()), ("need", pa.int32())])

    return _named(rows).mapInArrow(run, "key bigint, n bigint, dense boolean, whole boolean, need int, tokens array<bigint>")


def _with_tokens(rows: list[tuple], tokens: list[np.ndarray], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
    arrays = [pa.array([x[c] for x in rows], kind) for c, (_, kind) in enumerate(kinds)]
    arrays.append(pa.ListArray.from_arrays(ends, np.concatenate(tokens) if tokens else np.zeros(0, np.int64)))
    return pa.RecordBatch.from_arrays(arrays, [*(name for name, _ in kinds), "tokens"])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key no two rows share: doc_id, if it is so itself; else a number, of rows written once, as such numbers hold for one reading only."""
    tk.small_batches(docs.sparkSession)
    own = F.col("doc_id").cast("bigint")
    if docs.where(own.isNotNull()).groupBy(own.alias("i")).count().where("count > 1").isEmpty():
        return docs.withColumn("__key", own)
    return tk.checkpointed(docs.withColumn("__key", F.monotonically_increasing_id()))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("__key").alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.where("doc_id is not null and text is not null").select("key", "text")


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    r = parent[at]
    while True:
        up = parent[r]
        if (up == r).all():
            return r
        r = up


def _compare(t: float):
    """Of one cell: its members of smaller key for each query that opens the group. Rows: key, m, member, query, dense, copies, set. A pair of dense documents counts where m < 0, any other where m >= 0."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key")
        key, member, query, dense, copies = (tk.column(rows, c) for c in ("key", "member", "query", "dense", "copies"))
        sets = [np.frombuffer(x, tk.U64) for x in rows.column("set").to_pylist()]
        sizes = np.array(list(map(len, sets)))
        links, parent = np.zeros(len(key), np.int64), np.arange(len(key))
        ms = np.flatnonzero(member)
        if len(ms):
            both_dense = len(key) > 0 and rows.column("m")[0].as_py() < 0
            owner = np.repeat(np.arange(len(ms)), sizes[ms])
            flat = np.concatenate([sets[i] for i in ms.tolist()])
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for x in np.flatnonzero(query).tolist():
                s = sets[x]
                a, b = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
                n = b - a
                if (n > 0).sum() < t * len(s) - EPS:  # |Q & U| < t |Q|: no member can reach t, the group stays closed
                    continue
                at = np.repeat(a - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(ms))
                ok = (both / (sizes[ms] + len(s) - both) >= t) & (ms < x)
                if dense[x] and not both_dense:
                    ok &= ~dense[ms]
                y = ms[ok]
                if len(y):
                    links[x] += copies[y].sum()
                    links[y] += copies[x]
                    r = np.unique(_roots(parent, np.append(y, x)))
                    parent[r] = r[0]
                    parent[y] = r[0]
        got = np.flatnonzero(links)
        return pa.table([key[got], links[got], key[_roots(parent, got)]], pa.schema([("key", pa.int64()), ("links", pa.int64()), ("root", pa.int64())]))

    return run


PLACED = "gid bigint, m int, k int, key bigint, member boolean, query boolean, dense boolean, copies bigint, set binary"


def _placed_sets(rows: DataFrame, places: DataFrame, n: int) -> DataFrame:
    """PLACED: the sets (hashes as bytes) of documents, once for each of their places (key, gid, m, k, member, query, dense, copies)."""
    names = ["gid", "m", "k", "member", "query", "dense", "copies"]
    held = places.groupBy(F.col("key").alias("__at_key")).agg(F.collect_list(F.struct(*names)).alias("at"))
    rows = _named(rows).join(held, F.col("key") == F.col("__at_key")).select("key", "text", "at")
    cols = ["gid", "m", "k", "key", "member", "query", "dense", "copies", "set"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()]

    def run(batches):
        for b in batches:
            keys, lists = tk.column(b, "key"), b.column("at")
            out, size = [], 0
            for r, s in gram_sets(b.column("text"), n):
                raw = s.tobytes()
                for x in lists[r].as_py():
                    out.append((x["gid"], x["m"], x["k"], int(keys[r]), x["member"], x["query"], x["dense"], x["copies"], raw))
                    size += len(raw)
                    if size > tk.CHUNK_BYTES:  # small batches: the receiving side holds one at a time
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], cols)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], cols)

    return rows.mapInArrow(run, PLACED)


def classes(docs: DataFrame, n: int = N, t: float = T) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, sig1, sig2 of every row of keyed docs; sig1, sig2, class_id, stays, links of the sets that are linked or come more than once). stays: the key of the class's row of smallest doc_id."""
    spark = docs.sparkSession
    rows = _rows(docs)
    sets = tk.checkpointed(sets_of(rows, n))
    with_set = sets.where("sig1 is not null")
    reps = with_set.groupBy("sig1", "sig2").agg(F.min(F.struct("doc_id", "key")).alias("low"), F.count(F.lit(1)).alias("copies"))
    reps = tk.checkpointed(reps.select("sig1", "sig2", "low.key", "low.doc_id", "copies"))
    met = with_set.select("gid", F.explode("tokens").alias("token")).distinct()  # equal sets have one gid: copies count once
    counts = met.groupBy("token").agg(F.count(F.lit(1)).alias("groups")).where(F.col("groups") > HOT)
    hot = counts.orderBy(F.desc("groups"), "token").limit(MOST_HOT).select("token").toArrow()
    hot = np.sort(tk.unsigned(tk.column(hot, "token")))
    final = tk.checkpointed(sketches_of(rows, spark.sparkContext.broadcast(hot), n, t).join(reps.select("key", "copies"), "key"))
    places = _places(final.where("not whole"))
    whole = final.where("whole")
    if not whole.isEmpty():
        places = places.union(_places(whole).withColumn("m", -1 - F.col("m")))  # groups of their own
    places = places.join(final.select("key", "dense", "copies").distinct(), "key")
    found = _placed_sets(rows, places, n).groupBy("gid", "m", "k").applyInArrow(_compare(t), "key bigint, links bigint, root bigint")
    found = tk.checkpointed(found)
    near = found.groupBy("key").agg(F.sum("links").alias("near"))
    roots = components(found.where("key <> root").select(F.col("key").alias("doc_a"), F.col("root").alias("doc_b"))).withColumnRenamed("doc_id", "key")
    linked = reps.join(near, "key", "left").join(roots, "key", "left").where("copies > 1 or near is not null")
    linked = tk.checkpointed(linked.select("sig1", "sig2", "key", "doc_id", F.coalesce("root", "key").alias("root"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("links")))
    best = tk.checkpointed(linked.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("low")).select("root", F.col("low.doc_id").alias("class_id"), F.col("low.key").alias("stays")))
    linked = tk.checkpointed(linked.join(best, "root").select("sig1", "sig2", "class_id", "stays", "links"))
    return sets.select("key", "doc_id", "sig1", "sig2"), linked


def near_classes(docs: DataFrame, n: int = N, t: float = T) -> DataFrame:
    """doc_id, class_id, links: one row for each row of docs.

    links: how many other rows have an n-gram set at Jaccard t or more, copies among them. class_id: the smallest doc_id of all
    rows that links connect with this one, directly or through others; a row without links is a class of its own. Rows
    without doc_id, text or token link nothing; their class is their doc_id. Every row counts by itself: rows that repeat an id
    and a text are copies of each other, rows that repeat an id with other texts may be in several classes. Other columns
    are ignored; an empty table gives no rows.
    """
    rows, linked = classes(keyed(docs), n, t)
    alone = rows.where("sig1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("links"))
    rows = rows.where("sig1 is not null").join(linked, ["sig1", "sig2"], "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links")).unionByName(alone)


def _places(sketched: DataFrame) -> DataFrame:
    """key, gid, m, k, member, query: where documents must meet, by sketches that share as many tokens as needed."""
    each = sketched.select("key", "n", "need", F.explode("tokens").alias("token"))
    behind = tk.checkpointed(each.groupBy("token").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("docs")).where("docs > 1"))
    shared = tk.checkpointed(each.join(behind, "token"))  # a document that shares no token is out
    led = shared.groupBy("key", "leader").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    best = F.max_by("leader", F.when((F.col("leader") < F.col("key")) & (F.col("c") >= LIKE), F.struct("c", -F.col("leader"))))
    gids = led.groupBy("key").agg(F.coalesce(best, F.col("key")).alias("gid"), F.max("n").alias("n"))
    # a query that shares `need` tokens with a group shares one at least of any but need - 1 of its tokens: its most common ones open nothing
    skip = F.greatest(F.lit(0), F.col("need") - LEFT)
    w = Window.partitionBy("key").orderBy(F.desc("docs"), "token")
    ranked = shared.select("token", "key", "n", "need", (F.row_number().over(w) > skip).alias("opens"))
    rows = ranked.join(gids.drop("n"), "key").select("token", "key", "gid", "n", "need", "opens")
    columns = rows.groupBy("token", "gid").agg(F.min("key").alias("least"), F.max("n").alias("top"))  # the matrix: a group's union of tokens
    opened = rows.where("opens").select("token", F.col("key").alias("q"), "n", "need").join(columns, "token").where((F.col("q") > F.col("least")) & (F.col("n") * T <= F.col("top") + EPS))
    opened = opened.groupBy("q", "gid").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need"), F.max("n").alias("n"))
    opened = tk.checkpointed(opened.where(F.col("shared") >= F.col("need") - skip).select("q", "gid", "n"))
    groups = tk.checkpointed(gids.join(opened.select("gid").distinct(), "gid", "left_semi"))
    many = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_TOKENS))
    parts = tk.checkpointed(groups.groupBy("gid").agg(many.alias("__m")).join(opened.groupBy("gid").agg(many.alias("__q")), "gid"))
    part = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("bigint")
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col(k) - 1).cast("bigint")))
    members = groups.join(parts, "gid").select("key", "gid", part("key", "__m").alias("m"), upto("__q").alias("k"), F.lit(True).alias("member"), F.lit(False).alias("query"))
    queries = opened.join(parts, "gid").select(F.col("q").alias("key"), "gid", upto("__m").alias("m"), part("q", "__q").alias("k"), F.lit(False).alias("member"), F.lit(True).alias("query"))
    return members.union(queries).groupBy("key", "gid", F.col("m").cast("int").alias("m"), F.col("k").cast("int").alias("k")).agg(F.max("member").alias("member"), F.max("query").alias("query"))


def components(pairs: DataFrame) -> DataFrame:
    """doc_id, root: each document's smallest id among all that pairs link it to, by alternating large-star and small-star steps; documents without pairs aren't there."""
    edges = tk.checkpointed(pairs.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tk.checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # written, so that a node of many neighbours can be split in the join
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = tk.checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = tk.checkpointed(small.where("u <> v").distinct())
        # done once every node hangs on a root that hangs on nothing
        if new.select("v").distinct().join(new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            return new.select(F.col("u").alias("doc_id"), F.col("v").alias("root")).union(new.select(F.col("v").alias("doc_id"), F.col("v").alias("root")).distinct())
        edges = new


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(tk.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each class, that of the smallest doc_id. Rows without doc_id, text or tokens stay, and so do rows that repeat the id of a removed one with an unlike text."""
    own = keyed(docs)
    rows, linked = classes(own)
    drop = rows.join(linked, ["sig1", "sig2"]).where("key <> stays").select(F.col("key").alias("__drop"))
    return own.join(drop, F.col("__key") == F.col("__drop"), "left_anti").select(*docs.columns)


SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10ffff}}]+') as ws from documents where doc_id is not null)
, g as (select distinct doc_id, array_to_string(list_slice(ws, i, i + {N - 1}), ' ') as gram from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {N - 1}, 1) + 1)) as i from w where len(ws) > 0))
, c as (select doc_id, count(*) as n, list(gram order by gram) as all_grams from g group by doc_id)
, r as (select doc_id, n, min(doc_id) over (partition by all_grams) as rep, count(*) over (partition by all_grams) as copies from c)
, k as (select g.doc_id, gram from g join r using (doc_id) where doc_id = rep)
, p as (select a.doc_id as a, b.doc_id as b, count(*) as hits from k a join k b on a.gram = b.gram and a.doc_id < b.doc_id group by all)
, e as (select p.a, p.b, x.copies as ca, y.copies as cb from p join r x on x.doc_id = p.a join r y on y.doc_id = p.b where hits / (x.n + y.n - hits)::double >= {T})
, l as (select a as x, b as y, cb as copies from e union all select b, a, ca from e)
, reach as (select x, y from l union select reach.x, l.y from reach join l on reach.y = l.x)
, near as (select x, sum(copies) as links from l group by x)
, low as (select x, min(y) as y from reach group by x)
select d.doc_id, coalesce(least(rep, low.y), d.doc_id) as class_id, coalesce(copies - 1 + coalesce(links, 0), 0)::bigint as links
from documents d left join r on r.doc_id = d.doc_id left join near on near.x = rep left join low on low.x = rep
"""
