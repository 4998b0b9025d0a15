"""Language identification by multinomial naive Bayes over hashed character n-grams of the lower-cased text.

A character is a code point. fit() counts the n-grams of at most TRAIN_ROWS labelled documents into 2**BITS buckets a language and keeps the matrix of
log-probabilities (Laplace-smoothed), which is broadcast: its size is fixed by BITS and the number of languages, whatever
the corpus has. score() counts each chunk's (document, bucket) pairs into a sparse matrix and multiplies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textkit as tk

#: Labelled rows that fit() uses at most, those with the smallest MD5 of doc_id; whole texts of them.
TRAIN_ROWS = 4_000
#: Log-probabilities are whole numbers of so many to a nat, so that sums are exact in any order.
UNIT = 1 << 16
BITS, NGRAMS, SMOOTHING = 14, (1, 2, 3, 4), 0.5

SCHEMA = "doc_id bigint, n_grams bigint, lang_pred string, log_prob double, confidence double"


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # buckets x languages, whole numbers, as the prior's
    prior: np.ndarray


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the rows' offsets in them."""
    starts = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), starts[offs]


def pairs(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sparse count matrix of a chunk: rows, buckets, counts. N-grams don't cross rows; runs of blanks count as they are."""
    points, offs = characters(buf, offs)
    rows, n = len(offs) - 1, len(points)
    doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offs))
    size = 1 << BITS
    code = tk.mix(points.astype(tk.U64) + tk.U64(1)) | tk.U64(1)
    keys = []
    h = np.zeros(n, tk.U64)
    for k in range(1, max(NGRAMS) + 1):
        m = n - k + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            h = (h[:m] + code[k - 1 :]) * tk.U64(0x9E3779B97F4A7C15)
        if k in NGRAMS:
            ok = doc[:m] == doc[k - 1 :]
            x = doc[:m] * size + (h >> tk.U64(64 - BITS)).astype(np.int64)
            keys.append(x[ok])
    if not keys:
        z = np.zeros(0, np.int64)
        return z, z, z
    key = np.concatenate(keys)
    if rows * size <= 1 << 22:
        dense = np.bincount(key, minlength=1)
        at = np.flatnonzero(dense)
        count = dense[at]
    else:
        at, count = np.unique(key, return_counts=True)
    return at >> BITS, at & (size - 1), count


def _chunks(texts: pa.Array):
    """Chunks of at most 256 rows, so that the count matrix stays small."""
    for i, j, buf, offs in tk.lower_chunks(texts):
        for a in range(0, j - i, 256):
            b = min(a + 256, j - i)
            yield i + a, i + b, buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most train_rows rows with text and lang; without any, every prediction is null."""
    tk.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where("text <> '' and lang is not null")
    ids = rows.select("doc_id").where("doc_id is not null").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(train_rows)
    ids = docs.sparkSession.createDataFrame(ids.collect(), "__id bigint")  # train_rows bounds its size
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("text", "lang")

    def run(batches):
        for b in batches:
            names = np.asarray(b.column("lang").to_pylist(), object)
            for i, j, buf, offs in _chunks(b.column("text")):
                r, k, n = pairs(buf, offs)
                lang = names[i:j][r]
                for x in np.unique(names[i:j].astype(str)):
                    c = np.bincount(k[lang == x], n[lang == x], 1 << BITS).astype(np.int64)
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(at), pa.string()), "k": at, "n": c[at], "docs": np.full(len(at), int((names[i:j] == x).sum()) if len(at) else 0) * (np.arange(len(at)) == 0)})

    got = rows.mapInArrow(run, "lang string, k bigint, n bigint, docs bigint").groupBy("lang", "k").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).toPandas()
    langs = sorted(set(got["lang"]))
    if not langs:
        return Model([], np.zeros((1 << BITS, 1), np.int32), np.zeros(1, np.int64))
    counts = np.full((1 << BITS, max(1, len(langs))), SMOOTHING)
    counts[got["k"].to_numpy(int), [langs.index(x) for x in got["lang"]]] += got["n"].to_numpy(float)
    seen = got.groupby("lang")["docs"].sum()
    prior = np.log(np.array([seen[x] for x in langs], float) / float(seen.sum()))
    return Model(langs, np.rint(np.log(counts / counts.sum(0)) * UNIT).astype(np.int32), np.rint(prior * UNIT).astype(np.int64))


def predict(texts: pa.Array, m: Model) -> list[pa.Array]:
    """n_grams, lang_pred, log_prob, confidence."""
    total, best, lp, conf = [], [], [], []
    for i, j, buf, offs in _chunks(texts):
        r, k, n = pairs(buf, offs)
        rows = j - i
        s = np.stack([np.bincount(r, m.log_prob[k, c] * n, rows) for c in range(m.log_prob.shape[1])], 1) + m.prior
        count = np.bincount(r, n, rows)
        top = s.argmax(1)
        z = np.exp((s - s.max(1, keepdims=True)) / UNIT)
        total += count.astype(int).tolist()
        none = (count == 0) | (not m.langs)
        best += [None if e else m.langs[t] for e, t in zip(none, top)]
        lp += [None if e else float(x) / UNIT for e, x in zip(none, s.max(1))]
        conf += [None if e else round(float(x), 6) for e, x in zip(none, 1 / z.sum(1))]
    return [pa.array(total, pa.int64()), pa.array(best, pa.string()), pa.array(lp, pa.float64()), pa.array(conf, pa.float64())]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (SCHEMA), repeated rows and null ids too; null and empty texts have null predictions; ties go to the language first in the alphabet; other columns are ignored."""
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *predict(b.column("text"), m.value)], ["doc_id", "n_grams", "lang_pred", "log_prob", "confidence"])

    return tk.texts_of(docs).mapInArrow(run, SCHEMA)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.table(spark, sf_dir, "documents")
    return score(docs, fit(docs))


_C = 0x9E3779B97F4A7C15
_XOR = lambda h, n: f"xor({h}, ({h} >> {n}))"
_TIMES = lambda h, c: f"((({h})::uhugeint * {c}::uhugeint) % 18446744073709551616::uhugeint)::ubigint"
_NEXT = lambda h, c: f"((((({h}::uhugeint + {c}::uhugeint) % 18446744073709551616::uhugeint) * {_C}::uhugeint)) % 18446744073709551616::uhugeint)::ubigint"

SQL = f"""
with d as (select row_number() over () as r, doc_id, lang, text from documents)
, c0 as (select r, unnest(string_split(lower(text), '')) as ch, unnest(range(1, length(lower(text)) + 1)) as i from d where text <> '')
, p as (select ch, a | 1::ubigint as code from (select ch, {_XOR("b", 31)} as a from (select ch, {_TIMES(_XOR("x", 27), 0x94D049BB133111EB)} as b from (select ch, {_TIMES(_XOR("y", 30), 0xBF58476D1CE4E5B9)} as x from (select distinct ch, (unicode(ch) + 1)::ubigint as y from c0)))))
, c as (select r, i, code, lead(code, 1) over w as c2, lead(code, 2) over w as c3, lead(code, 3) over w as c4 from c0 join p using (ch) window w as (partition by r order by i))
, h1 as (select r, c2, c3, c4, {_NEXT("0", "code")} as h from c)
, h2 as (select r, c3, c4, h, case when c2 is not null then {_NEXT("h", "c2")} end as g from h1)
, h3 as (select r, c4, h, g, case when c3 is not null then {_NEXT("g", "c3")} end as f from h2)
, h4 as (select r, h, g, f, case when c4 is not null then {_NEXT("f", "c4")} end as e from h3)
, n as (select r, k, count(*) as n from (select r, unnest([h, g, f, e]) >> {64 - BITS} as k from h4) where k is not null group by r, k)
, ids as (select doc_id from (select distinct doc_id from d where text <> '' and lang is not null and doc_id is not null) order by md5(doc_id::varchar), doc_id limit {TRAIN_ROWS})
, tr as (select r, lang from d semi join ids using (doc_id) where text <> '' and lang is not null)
, m as (select lang, k, sum(n) as n from n join tr using (r) group by lang, k)
, total as (select lang, sum(n) + {SMOOTHING} * {1 << BITS} as total from m group by lang)
, prior as (select lang, round(ln(count(*) / (select count(*) from tr)::double) * {UNIT}) as prior from tr group by lang)
, s0 as (select r, sum(n) as n_grams, list(k) as ks from n group by r)
, s1 as (select n.r, l.lang, sum(n.n * coalesce(round(ln((m.n + {SMOOTHING}) / l.total) * {UNIT}), round(ln({SMOOTHING} / l.total) * {UNIT}))) as s from n cross join total l left join m on m.lang = l.lang and m.k = n.k group by n.r, l.lang)
, s2 as (select r, lang, s + prior as s from s1 join prior using (lang))
, b as (select r, max(s) as top from s2 group by r)
, o as (select r, min(lang) filter (s = top) as lang_pred, max(top) / {UNIT}.0::double as log_prob, round(1 / sum(exp((s - top) / {UNIT}.0::double)), 6) as confidence from s2 join b using (r) group by r)
select doc_id, coalesce(n_grams, 0)::bigint as n_grams, lang_pred, log_prob, confidence from d left join s0 using (r) left join o using (r)
"""
