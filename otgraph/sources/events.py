"""Tag payloads and OT events: read, parse, map, split corrupt records, write
(S6, S7, S8, S13, P9, P10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from otgraph.functions.events import quality_fields, tag_provider, typed_value
from otgraph.schemas import OT_EVENT

_PAYLOAD_SCHEMA = ("STRUCT<tagPath: STRING, tagProvider: STRING, quality: STRING, "
                   "qualityCode: INT, timestamp: BIGINT, dataType: STRING>")


def read_payload_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines (one object or one array of objects per line) as a ``line`` column."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def split_corrupt(lines: DataFrame, col: str = "line") -> tuple[DataFrame, DataFrame]:
    """(good, dead_letter): a line that is not JSON goes to the dead letter, never fails."""
    parsed = lines.withColumn("_v", F.try_parse_json(F.col(col)))
    good = parsed.filter(F.col("_v").isNotNull())
    dead = parsed.filter(F.col("_v").isNull()).drop("_v")
    return good, dead


def parse_tag_payloads(lines: DataFrame, col: str = "line",
                       keep: tuple[str, ...] = (), parsed: str | None = None) -> DataFrame:
    """JSON payload lines → one row per tag event.

    A line holds one object or an array of objects. The dynamic ``value`` stays a VARIANT; the
    other fields are read with their fixed types. Lines that are not JSON are dropped here —
    use :func:`split_corrupt` first to keep them; pass its ``_v`` column as ``parsed`` so
    lines are parsed once.
    """
    v = F.col(parsed) if parsed else F.try_parse_json(F.col(col))
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"),
                   F.try_variant_get(v, "$", "ARRAY<VARIANT>")).otherwise(F.array(v))
    exploded = lines.select(*keep, F.explode(items).alias("_e"))
    e = F.col("_e")
    return exploded.select(
        *keep,
        F.try_variant_get(e, "$.tagPath", "string").alias("tag_path"),
        F.try_variant_get(e, "$.value", "variant").alias("value"),
        F.try_variant_get(e, "$.quality", "string").alias("quality"),
        F.try_variant_get(e, "$.timestamp", "bigint").alias("timestamp_ms"),
        F.try_variant_get(e, "$.tagProvider", "string").alias("tag_provider_hint"),
    )


def payload_defaults(df: DataFrame, now: Column | None = None, source: str = "http") -> DataFrame:
    """Missing timestamp → now; missing quality → GOOD over HTTP, UNKNOWN for direct events."""
    now = now if now is not None else F.current_timestamp()
    fallback_q = "GOOD" if source == "http" else "UNKNOWN"
    return df.withColumns({
        "event_ts": F.coalesce(F.timestamp_millis(F.col("timestamp_ms")), now),
        "quality": F.coalesce(F.col("quality"), F.lit(fallback_q)),
    })


def content_event_id(tag_path: Column, event_ts: Column, value: Column, quality: Column
                     ) -> Column:
    """A UUID-shaped id derived from the event's content: a recomputed partition (lost
    executor) or a replayed event gets the same id, so downstream dedupe stays exact."""
    h = F.md5(F.concat_ws("\u0001", tag_path, event_ts.cast("string"),
                          F.to_json(value), quality))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def map_ot_event(df: DataFrame, source_system: str, include_quality: bool = True,
                 event_id: Column | None = None, ingest_ts: Column | None = None,
                 compat_defaults: bool = False) -> DataFrame:
    """Raw tag events (tag_path, value VARIANT, quality, event_ts) → the 14-column OT event (P10).

    ``event_id`` defaults to :func:`content_event_id` (the gateway draws a random UUID; a Spark
    task must give the same answer when it is re-run) and ``ingest_ts`` to the query's current
    time. With ``compat_defaults`` the typed value columns that do not apply hold 0.0 / '' /
    false instead of NULL.
    """
    tv = typed_value(F.col("value"))
    q = quality_fields(F.col("quality"), include_quality)
    num, txt, boo = tv["numeric_value"], tv["string_value"], tv["boolean_value"]
    if compat_defaults:
        num, txt, boo = (F.coalesce(num, F.lit(0.0)), F.coalesce(txt, F.lit("")),
                         F.coalesce(boo, F.lit(False)))
    ingest = ingest_ts if ingest_ts is not None else F.current_timestamp()
    return df.select(
        (event_id if event_id is not None else content_event_id(
            F.col("tag_path"), F.col("event_ts"), F.col("value"), F.col("quality")))
        .cast("string").alias("event_id"),
        F.col("event_ts").cast("timestamp").alias("event_time"),
        F.coalesce(F.col("tag_path"), F.lit("")).alias("tag_path"),
        tag_provider(F.col("tag_path")).alias("tag_provider"),
        num.alias("numeric_value"), txt.alias("string_value"), boo.alias("boolean_value"),
        q["quality"].alias("quality"), q["quality_code"].cast("int").alias("quality_code"),
        F.lit(source_system).alias("source_system"),
        F.unix_micros(ingest.cast("timestamp")).alias("ingestion_timestamp"),
        tv["data_type"].alias("data_type"),
        F.lit("").alias("alarm_state"), F.lit(0).alias("alarm_priority"),
    )


def read_ot_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan the 14-column event bronze with its fixed schema."""
    return spark.read.schema(OT_EVENT).format(fmt).load(path)


def write_ot_events(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("event_date",),
                    mode: str = "append") -> None:
    """Append events partitioned by event date so time filters prune files (S8, batch form)."""
    out = df.withColumn("event_date", F.to_date("event_time")) if "event_date" in partition_by \
        else df
    out.write.mode(mode).partitionBy(*partition_by).parquet(path)
