"""Best-fit packing planned on the length histogram.

Documents are cut into pieces of at most CAPACITY tokens (full pieces and a rest). The driver sees only how many pieces
each length has (at most CAPACITY numbers) and runs best-fit decreasing over the counts: pieces of one length go, as many at
once as there are, into the open bins with the least room that is enough, then into new bins. The plan is runs of slots
(length, ranks, bins, offset); its size depends on CAPACITY, not on the corpus. A piece takes the slot of its rank
within its length. Ranks come in two levels, bucket by bucket, so that no task sorts all pieces of a common length; a length has
as many buckets as its pieces need.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelflow.llm import textkit as tk

CAPACITY = 2048
#: Pieces of one length that are ranked in one bucket, about.
BUCKET = 500_000
#: Rows of the plan up to which it is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 200_000

Run = tuple[int, int, int, int, int]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing over counts: (length, first rank, count, first bin, offset), ranks from 0. Same bins as packing piece by piece, longest first, each into the fullest bin that has room."""
    out: list[Run] = []
    open_bins: dict[int, list[list[int]]] = {}  # room -> [first bin, bins]
    rooms: list[int] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in open_bins:
                open_bins[room] = []
                bisect.insort(rooms, room)
            runs = open_bins[room]
            if runs and runs[-1][0] + runs[-1][1] == first:
                runs[-1][1] += n
            else:
                runs.append([first, n])

    for length in sorted((x for x, n in histogram.items() if x > 0 and n > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // length  # a bin that took a piece is the fullest that fits until it takes no more
            use = -(-left // each)
            if at < len(rooms):
                run = open_bins[room][-1]
                use = min(use, run[1])
                first = run[0] + run[1] - use
                run[1] -= use
                if not run[1]:
                    open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room], rooms[at]
            else:
                first, bins = bins, bins + use
            full, rest = divmod(min(left, use * each), each)
            for k in range(each):
                for start, n in ((first, full), (first + full, int(k < rest))):
                    if n:
                        out.append((length, rank, n, start, capacity - room + k * length))
                        rank += n
            if full:
                put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            left -= full * each + rest
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length: a document's words and one end mark, cut to the capacity. Null and empty texts are one piece, the end mark. Null ids stay."""
    n = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(r"\S+")), F.lit(0)).cast("bigint") + 1
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), n.alias("__n"))
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / capacity).cast("bigint")))
    x = sized.select("doc_id", "__n", cut.alias("piece"))
    return x.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("__n") - F.col("piece") * capacity).alias("length"))


def pack(docs: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """doc_id, piece, start, length, bin_id, bin_offset: one row for each piece of each row of docs. Bins are numbered from 0, hold at most `capacity` tokens and their pieces don't overlap. Equal lengths and repeated rows rank in any order; each takes a slot of its own. An empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    rows = tk.checkpointed(pieces(docs, capacity))  # numbers only; both readers use the same
    sizes = [(r[0], -(-r[1] // bucket)) for r in rows.groupBy("length").count().collect()]  # at most capacity rows
    sizes = F.broadcast(spark.createDataFrame(sizes, "length bigint, __buckets bigint"))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "start", F.monotonically_increasing_id()), F.col("__buckets"))
    rows = tk.checkpointed(rows.join(sizes, "length").select("doc_id", "piece", "start", "length", spread.alias("__bucket")))
    counts = rows.groupBy("length", "__bucket").count().collect()  # a row for each `bucket` pieces, and capacity rows at most besides
    histogram: dict[int, int] = {}
    before = []
    for length, b, n in sorted((r[0], r[1], r[2]) for r in counts):
        before.append((length, b, histogram.get(length, 0)))
        histogram[length] = histogram.get(length, 0) + n
    runs = plan(histogram, capacity)
    small = F.broadcast if max(len(runs), len(before)) <= BROADCAST_ROWS else lambda df: df
    starts = small(spark.createDataFrame(before, "__l bigint, __b bigint, __before bigint"))
    slots = small(spark.createDataFrame(runs, "__length bigint, __first bigint, __count bigint, __bin bigint, __at bigint"))
    w = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start")
    ranked = rows.withColumn("__rn", F.row_number().over(w) - 1)
    ranked = ranked.join(starts, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b"))).withColumn("__rank", F.col("__rn") + F.col("__before"))
    j = ranked.join(slots, (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__count")))
    return j.select("doc_id", "piece", "start", "length", (F.col("__bin") + F.col("__rank") - F.col("__first")).alias("bin_id"), F.col("__at").alias("bin_offset"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tk.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document left goes."""
    return pack(docs)
