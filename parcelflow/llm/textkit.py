"""Vectorised text kernels shared by the corpus operators.

Texts arrive as Arrow string arrays; everything below works on their UTF-8 buffers with numpy, in chunks of a quarter
of a megabyte, so a task's memory doesn't depend on how many rows an Arrow batch has. A token is a maximal run of ASCII letters,
digits and bytes from 0x80 on, of the lower-cased text. Hashes are 64-bit polynomials over a random byte table, finished
by a mixer; equal tokens have equal hashes on every machine.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.session import cut, shared_folder  # noqa: F401

U64 = np.uint64
CHUNK_BYTES = 1 << 18
#: Rows of an Arrow batch, where the session has Spark's default.
BATCH_ROWS = 2_000
_BASE, _NBASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (the splitmix64 one)."""
    h = np.asarray(h, U64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


with np.errstate(over="ignore"):
    BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
SPACE_BYTE = np.zeros(256, bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        with np.errstate(over="ignore"):
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, U64(b))
                p[0] = 1
                both.append(np.cumprod(p, dtype=U64))
        _powers[base] = have = (both[0], both[1])
    return have


def lowered(texts: pa.Array) -> pa.Array:
    """Lower-cased texts, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))


def plain(texts: pa.Array) -> pa.Array:
    """The texts as they are, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pc.fill_null(texts.cast(pa.large_string()), "")


def chunked(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them): whole rows, about `most` bytes at once; a longer row comes alone."""
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lower_chunks(texts: pa.Array, most: int = CHUNK_BYTES, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """chunked(lowered(texts)), a few rows at a time, so that no second copy of a whole Arrow batch is made."""
    return _sliced(texts, lowered, most, rows)


def plain_chunks(texts: pa.Array, most: int = CHUNK_BYTES, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return _sliced(texts, plain, most, rows)


def _sliced(texts, prepare, most: int, rows: int):
    for a in range(0, len(texts), rows):
        for i, j, buf, offs in chunked(prepare(texts.slice(a, rows)), most):
            yield a + i, a + j, buf, offs
    pa.default_memory_pool().release_unused()  # two workers share an executor's memory with its JVM


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default for this session, as whole texts are large rows. A setting of the user's own stays, whatever its value."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not spark._jsparkSession.conf().contains(key):
        spark.conf.set(key, str(BATCH_ROWS))


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text: what the kernels read of documents, whatever other columns there are."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def spans(buf: np.ndarray, offs: np.ndarray, wanted: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of wanted bytes inside each row, and each row's first run."""
    w = wanted[buf]
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    at = offs[:-1][offs[:-1] < n]
    first[at] = w[at]
    at = offs[1:] - 1
    at = at[at >= 0]
    last[at] = w[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every run of bytes; the runs are in order and don't overlap."""
    out = np.empty(len(starts), U64)
    i, n = 0, len(starts)
    while i < n:
        s = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, s + CHUNK_BYTES, "right")))
        e = ends[j - 1]
        p, inv = powers(_BASE, int(e - s) + 1)
        with np.errstate(over="ignore"):
            c = np.zeros(int(e - s) + 1, U64)
            np.cumsum(BYTE_CODE[buf[s:e]] * p[: e - s], dtype=U64, out=c[1:])
            a, b = starts[i:j] - s, ends[i:j] - s
            out[i:j] = (c[b] - c[a]) * inv[a] + (b - a).astype(U64)
        i = j
    return mix(out)


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, each row's first token, hashes."""
    starts, ends, first = spans(buf, offs)
    return starts, ends, first, run_hashes(buf, starts, ends)


class Grams:
    """Hashes of n-grams of a hash sequence, for any n, from one running sum."""

    def __init__(self, h: np.ndarray):
        p, self.inv = powers(_NBASE, len(h) + 1)
        with np.errstate(over="ignore"):
            self.c = np.zeros(len(h) + 1, U64)
            np.cumsum(h * p[: len(h)], dtype=U64, out=self.c[1:])

    def of(self, n: int) -> np.ndarray:
        """Of the n-grams from each position on; those that cross rows are there too."""
        k = max(0, len(self.c) - n)
        with np.errstate(over="ignore"):
            return mix((self.c[n:] - self.c[:k]) * self.inv[:k] + U64(n))


def word_hash(*words: str) -> list[int]:
    """The hashes that tokens() gives to these tokens."""
    raw = [w.encode() for w in words]
    buf, ends = np.frombuffer(b" ".join(raw) + b" ", np.uint8), np.cumsum([len(r) + 1 for r in raw]) - 1
    return [int(x) for x in run_hashes(buf, np.array([0, *(ends[:-1] + 1)]), ends)]


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to path as Parquet and read again; Spark's file system removes it when the application ends."""
    spark = df.sparkSession
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    return cut(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, U64).view(np.int64)


def unsigned(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h, np.int64).view(U64)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    c = batch.column(name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    return c.to_numpy(zero_copy_only=False)
