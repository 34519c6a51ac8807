"""WARC archives: written by Spark, read back by boundary-chain verification.

Writing: one record per page in plain text archives (``response`` with the payload, ``revisit`` without).
Reading: the archives are split at every occurrence of the record magic, by byte ranges in parallel.
Each piece is a *candidate* record; its header gives the offset of its successor. Pointer jumping from
offset 0 of each file (jump lengths double each round) keeps the records that the chain reaches, so a
magic inside a payload is rejected however well it imitates a record. Payloads that hold a magic are
put together again from their pieces.

Defined results: null and empty payloads are responses of 0 bytes; payloads of ``MIN_REVISIT`` bytes or more
that are equal (SHA-1 and length) form a group: the row with the largest page_id is the response, the
others revisit it; rows that repeat that page_id and payload are written as responses again; a null
page_id is smaller than all others, and a group of null ids only has responses only; null urls are
empty; line breaks in a url are percent-encoded; records cut off at a file's end are dropped; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from otgraph.llm.common import scratch, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000            # bytes
RECORDS_PER_FILE = 4096       # bounds a chain, and so the rounds of pointer jumping
DATE = "1970-01-01T00:00:00Z"


# ---- writing --------------------------------------------------------------------------------
def classified(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: response)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    big = rows.where(F.col("payload_bytes") >= MIN_REVISIT)
    # only groups of two or more go on; written first, so the planner knows their size
    lead = written(big.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("lead"), F.count("*").alias("n"))
                   .where("n > 1 and lead is not null").select("payload_digest", "payload_bytes", "lead"), "warc-groups")
    j = rows.join(lead, ["payload_digest", "payload_bytes"], "left")
    return j.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("lead")), F.col("lead")))


def record_text(rows: DataFrame) -> Column:
    """The record without its closing blank lines (the writer's line separator)."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    pid = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    same = [F.lit("\r\nWARC-Record-ID: <urn:page:"), pid, F.lit(">\r\nWARC-Date: " + DATE + "\r\nWARC-Target-URI: "), url,
            F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string")]
    response = F.concat(F.lit(MAGIC + "WARC-Type: response"), *same, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
                        (F.octet_length(http) + F.col("payload_bytes")).cast("string"), F.lit(END), http, F.col("payload"))
    revisit = F.concat(F.lit(MAGIC + "WARC-Type: revisit"), *same, F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"),
                       F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nContent-Length: 0\r\n\r\n"))
    return F.when(F.col("refers_to").isNull(), response).otherwise(revisit)


def write_archives(pages: DataFrame, path: str) -> None:
    rows = classified(pages)
    (rows.select(record_text(rows).alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


# ---- reading --------------------------------------------------------------------------------
def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics, with file, byte range and order."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("nth"), "value")


def _field(header: Column, name: str, pattern: str) -> Column:
    return F.regexp_extract(header, rf"(?im)^{name}: *{pattern}\s*$", 1)


def _parsed(value: Column) -> list[Column]:
    """Header fields of a candidate, and size and digest of the payload if it is whole."""
    header = F.substring_index(value, END, 1)
    head_bytes = F.octet_length(header) + 4
    raw = value.cast("binary")
    body = F.substring_index(F.substring_index(value, END, 2), END, -1)
    http = F.when(F.lower(_field(header, "WARC-Type", r"(\S+)")) == "response", F.octet_length(body) + 4).otherwise(0)
    size = _field(header, "Content-Length", r"(\d{1,18})").try_cast("long")
    payload_at = head_bytes + http
    payload_len = head_bytes + size - payload_at
    payload = F.substring(raw, payload_at + 1, F.greatest(payload_len, F.lit(0)).cast("int"))
    return [head_bytes.cast("long").alias("head_bytes"), size.alias("size"), F.lower(_field(header, "WARC-Type", r"(\S+)")).alias("record_type"),
            _field(header, "WARC-Record-ID", r"<urn:page:(\S+)>").try_cast("long").alias("page_id"),
            _field(header, "WARC-Refers-To", r"<urn:page:(\S+)>").try_cast("long").alias("refers_to"),
            _field(header, "WARC-Target-URI", r"(.*?)").alias("url"), _field(header, "WARC-Payload-Digest", r"sha1:(\w+)").alias("stated_digest"),
            _field(header, "X-Payload-Length", r"(\d{1,18})").try_cast("long").alias("stated_bytes"),
            F.greatest(payload_len, F.lit(0)).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest")]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic of every archive: offset, successor, header fields; small rows, no payloads."""
    rows = _pieces(spark, path)
    small = written(rows.select("file", "block", "nth", F.octet_length("value").cast("long").alias("bytes"), *_parsed(F.col("value"))), "warc-candidates")
    step = F.col("bytes") + len(MAGIC)
    blocks = small.groupBy("file", "block").agg(F.sum(step).alias("total"))
    upto = F.sum("total").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("total").over(Window.partitionBy("file"))
    blocks = blocks.select("file", "block", F.coalesce(upto, F.lit(0)).alias("base"), (whole - len(MAGIC)).alias("file_bytes"))
    inside = F.sum(step).over(Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    out = small.withColumn("inside", F.coalesce(inside, F.lit(0))).join(blocks, ["file", "block"])
    out = out.withColumn("offset", F.col("base") + F.col("inside") - len(MAGIC))
    # the piece before the first magic is no candidate; one without a length has no successor
    return (out.where("offset >= 0")
            .withColumn("succ", F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("size") + len(END))
            .withColumn("next_magic", F.col("offset") + len(MAGIC) + F.col("bytes")).drop("inside", "base"))


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) on the chain of successors from offset 0, by pointer jumping. The tables grow with the pages, so
    none is broadcast."""
    jump = written(links.select("file", "offset", "succ"), "warc-jump")
    seen = written(jump.where("offset = 0").select("file", "offset"), "warc-seen")
    while jump.limit(1).count():
        there = links.select("file", F.col("offset").alias("to"))
        ahead = (seen.join(jump.hint("merge"), ["file", "offset"]).select("file", F.col("succ").alias("to"))
                 .join(there.hint("merge"), ["file", "to"], "left_semi").select("file", F.col("to").alias("offset")))
        seen = written(seen.union(ahead).distinct(), "warc-seen")
        onward = jump.select("file", F.col("offset").alias("succ"), F.col("succ").alias("far"))
        jump = written(jump.join(onward.hint("merge"), ["file", "succ"]).select("file", "offset", F.col("far").alias("succ")), "warc-jump")
    return seen


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every true record."""
    cand = written(candidates(spark, path), "warc-links")
    true = cand.join(reachable(cand.where("succ is not null")).hint("merge"), ["file", "offset"]).where("succ <= file_bytes")
    plain = true.where("succ = next_magic or succ = file_bytes and next_magic >= succ")
    torn = written(true.where("succ > next_magic").select("file", "offset", "succ"), "warc-torn")
    fields = ["page_id", "record_type", "refers_to", "url", "stated_digest", "stated_bytes", "payload_bytes", "payload_digest"]
    out = plain.select(*fields)
    if torn.limit(1).count():
        # payloads with a magic inside: each piece belongs to the last true record before it
        part = cand.select("file", "block", "nth", "offset").join(torn.select("file", "offset", F.col("succ").alias("end")), ["file", "offset"], "left")
        w = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
        part = part.withColumn("own", F.last(F.when(F.col("end").isNotNull(), F.struct("offset", "end")), True).over(w))
        part = part.where("own is not null and offset < own.end").select("file", "block", "nth", "offset", F.col("own.offset").alias("start"))
        text = _pieces(spark, path).join(part, ["file", "block", "nth"]).groupBy("file", "start").agg(
            F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("p"))
        text = text.select(F.array_join(F.transform("p", lambda x: x["value"]), MAGIC).alias("value"))
        out = out.union(text.select(*_parsed(F.col("value"))).select(*fields))
    back = F.col("record_type") == "revisit"
    return out.select("page_id", F.when(back, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                      F.when(back, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
                      "record_type", F.when(back, F.col("refers_to")).alias("refers_to"), "url")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
