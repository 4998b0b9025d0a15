"""A content-addressed WARC archive.

archive() parts raw records into `heads` (each record's exact header block, its payload's digest) and `payloads` (each
distinct payload once, by SHA-256). Equal digests are verified: all payloads that share one must be equal byte for byte (the set of them
has one member), the stored payload must hash to its digest, and a rebuilt record must hash to what the original record did.
reconstruct() joins them to the original bytes. A payload crosses the network once, copies being put together before the shuffle: the
grouping by digest and the joining by digest use the same partitioning. Heads of a digest with over HOT copies are spread
over as many tasks as they need, and its payload is sent to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import textkit as tk

CRLF = "\r\n"
#: Heads of one digest that one task joins at most.
HOT = 10_000


def header(url: Column, number: Column, length: Column) -> Column:
    """The header block, blank line included, of a resource record."""
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), F.coalesce(number.cast("string"), F.lit("none")),
        F.lit(f">{CRLF}Content-Type: text/html{CRLF}Content-Length: "), length.cast("string"), F.lit(CRLF * 2),
    )


def records(pages: DataFrame) -> DataFrame:
    """page_id, raw: one WARC record for each page; a null html is an empty payload, a null url an empty one. Repeated pages give repeated records."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", F.concat(header(F.col("url"), F.col("page_id"), F.octet_length(body)).cast("binary"), body, F.lit(CRLF * 2).cast("binary")).alias("raw"))


def split(raw: DataFrame) -> DataFrame:
    """page_id, head, payload, tail of raw records: the head ends after the first blank line; the payload has the length that Content-Length says, the tail is what follows. A record without a blank line is all head; without a proper Content-Length its payload goes to the end."""
    text = F.decode("raw", "ISO-8859-1")  # one character a byte
    at = F.locate(CRLF * 2, text)
    cut = F.when(at > 0, at + 3).otherwise(F.octet_length("raw"))
    said = F.regexp_extract(F.substring(text, F.lit(1), F.col("__cut")), r"(?i)\r\nContent-Length: *([0-9]{1,9})\r\n", 1)
    x = raw.select("page_id", "raw", cut.cast("int").alias("__cut")).withColumn("__said", said)
    room = F.octet_length("raw") - F.col("__cut")
    x = x.withColumn("__n", F.least(F.when(F.col("__said") == "", room).otherwise(F.col("__said").try_cast("int")), room))
    part = lambda a, n: F.substring(F.col("raw"), a, n)
    return x.select(
        "page_id", part(F.lit(1), F.col("__cut")).alias("head"), part(F.col("__cut") + 1, F.col("__n")).alias("payload"), part(F.col("__cut") + F.col("__n") + 1, F.octet_length("raw")).alias("tail")
    )


def archive(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """heads (page_id, head, tail, digest, record_digest), payloads (digest, payload, copies, verified).

    raw has page_id and raw (binary); other columns are ignored. A null raw is left out. Equal records stay as many heads with one payload. verified: the stored payload hashes to the digest and all payloads of the digest are equal.
    """
    whole = raw.where("raw is not null")
    parts = split(whole).withColumn("digest", F.sha2("payload", 256))
    heads = parts.select("page_id", "head", "tail", "digest", F.sha2(F.concat("head", "payload", "tail"), 256).alias("record_digest"))
    payloads = parts.groupBy("digest").agg(F.collect_set("payload").alias("__all"), F.count(F.lit(1)).alias("copies"))
    payloads = payloads.select("digest", F.array_min("__all").alias("payload"), "copies", (F.size("__all") == 1).alias("__one"))
    payloads = payloads.select("digest", "payload", "copies", (F.col("__one") & (F.sha2("payload", 256) == F.col("digest"))).alias("verified"))
    return heads, payloads


def reconstruct(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """page_id, raw, digest, payload_bytes, copies, intact: the original records, one for each head. intact: the payload is verified and the record hashes to what was archived."""
    hot = tk.checkpointed(heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("digest", F.ceil(F.col("n") / HOT).alias("__tasks")))
    if hot.isEmpty():
        j = heads.join(payloads, "digest")
    else:
        last = F.col("__tasks") - 1
        sent = payloads.join(hot, "digest").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        spread = heads.join(hot, "digest").withColumn("__part", F.pmod(F.xxhash64("page_id", "record_digest", F.monotonically_increasing_id()), F.col("__tasks")))
        names = ["head", "tail", "digest", "record_digest", "page_id", "payload", "copies", "verified"]
        j = heads.join(hot, "digest", "left_anti").join(payloads, "digest").select(*names).union(spread.join(sent, ["digest", "__part"]).select(*names))
    raw = F.concat("head", "payload", "tail")
    return j.select("page_id", raw.alias("raw"), "digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "copies", (F.col("verified") & (F.sha2(raw, 256) == F.col("record_digest"))).alias("intact"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, payloads = archive(records(tk.table(spark, sf_dir, "pages")))
    r = reconstruct(heads, payloads)
    return r.select("page_id", F.decode("raw", "UTF-8").alias("record"), "digest", "payload_bytes", "copies", "intact")


SQL = r"""
select page_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, 'none') || '>'
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::varchar || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record,
    sha256(coalesce(html, '')) as digest, strlen(coalesce(html, ''))::bigint as payload_bytes, count(*) over (partition by coalesce(html, '')) as copies, true as intact
from pages
"""
