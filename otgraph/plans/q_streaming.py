"""Registered streaming queries: each reads the events table as a stream, runs it to the end
with an ``availableNow`` trigger into a sink under ``spark.checkpoint.dir`` and returns the sink.
Their oracles are those of the batch twins, which is the stream = batch property."""

from __future__ import annotations

from pyspark.sql import functions as F

from otgraph.plans.adapters import (fold_sql, ot_events_from, table, tag_payload_lines,
                                    telemetry_mapping, telemetry_wide, with_ctes)
from otgraph.plans.catalog import register
from otgraph.plans.q_events import OT_COLS
from otgraph.sources.sinks import read_snapshot
from otgraph.streaming import ingest as S
from otgraph.streaming.metrics import MetricsListener, read_metrics, total_metrics
from otgraph.streaming.ordered import ordered_deadband_stream, rate_cap_stream
from otgraph.streaming.stateful import deadband_stream


#: Rows of one input file of a stream that is fed in steps.
_FILE_ROWS = 200_000


def _fed(parts, base):
    """A function that writes step f (column ``_f``, 0 to 3) of a stream's input, and the files of each step: as many for every
    step, so that ``maxFilesPerTrigger`` takes a step at a time; a step of few rows is one file."""
    rows = {r["_f"]: r["count"] for r in parts.groupBy("_f").count().collect()}      # four rows
    files = max(1, min(rows.get(f, 0) for f in range(4)) // _FILE_ROWS)

    def write(f, deal=lambda df, n: df.repartition(n)):
        step = parts.where(F.col("_f") == f).drop("_f")
        deal(step, files).write.parquet(f"{base}/in/{f}")
    return write, files


def _events_stream(spark, sf):
    # the streaming file source wants a folder or a glob; this glob matches the one file
    return S.stream_table(spark, f"{sf}/events.parque[t]")


@register("stream_mapping_triples", with_ctes("SELECT s, p, o, timestamp FROM triples", "triples"))
def q_stream_mapping(spark, sf):
    st = S.map_stream(telemetry_wide(_events_stream(spark, sf)), telemetry_mapping())
    return S.run_available(st, spark, "mapping")


@register("stream_dedupe", with_ctes(f"SELECT {OT_COLS} FROM ot_events", "ot_events"))
def q_stream_dedupe(spark, sf):
    ev = _events_stream(spark, sf)
    replayed = ot_events_from(ev).unionByName(ot_events_from(_events_stream(spark, sf)))
    st = S.dedupe_events(replayed, "10 minutes")
    return S.run_available(st, spark, "dedupe")


@register("stream_deadband", with_ctes(
    f"SELECT {OT_COLS} FROM fev JOIN fold USING (tag_path, rn) WHERE keep", "ot_events",
    extra=fold_sql("ot_events", 50.0), recursive=True))
def q_stream_deadband(spark, sf):
    st = deadband_stream(ot_events_from(_events_stream(spark, sf)), 50.0)
    return S.run_available(st, spark, "deadband")


@register("stream_rollup", with_ctes(
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, 'asset-' || CAST(user_id AS VARCHAR)"
    " AS asset_id, event_type AS signal_name, avg(value) AS avg_value, min(value) AS min_value,"
    " max(value) AS max_value, arg_max(value, (ts, value)) AS last_value, count(*) AS n FROM events GROUP BY 1, 2, 3"
    " HAVING bucket_start + INTERVAL 1 HOUR <="
    " (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES", "telemetry"), rounded=('avg_value',))
def q_stream_rollup(spark, sf):
    ev = _events_stream(spark, sf).select(
        F.col("ts").cast("timestamp").alias("event_time"),
        F.concat(F.lit("asset-"), F.col("user_id").cast("string")).alias("asset_id"),
        F.col("event_type").alias("signal_name"), F.col("value").alias("value_numeric"))
    st = S.rollup_stream(ev, "1 hour", "10 minutes")
    return S.run_available(st, spark, "rollup")


@register("stream_rollup_chain", with_ctes(
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS bucket_start, 'asset-' || CAST(user_id AS VARCHAR)"
    " AS asset_id, event_type AS signal_name, avg(value) AS avg_value, min(value) AS min_value,"
    " max(value) AS max_value, arg_max(value, (ts, event_id, value)) AS last_value, count(*) AS n FROM events GROUP BY 1, 2, 3"
    " HAVING bucket_start + INTERVAL 1 DAY <="
    " (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES", "telemetry"), rounded=('avg_value',))
def q_stream_rollup_chain(spark, sf):
    """Days from hours from 5 minutes, three stateful windows in a row."""
    ev = _events_stream(spark, sf).select(
        F.col("ts").cast("timestamp").alias("event_time"), "event_id",
        F.concat(F.lit("asset-"), F.col("user_id").cast("string")).alias("asset_id"),
        F.col("event_type").alias("signal_name"), F.col("value").alias("value_numeric"))
    st = S.rollup_chain_stream(ev, ["5 minutes", "1 hour", "1 day"], "10 minutes", tie="event_id")
    return S.run_available(st, spark, "rollup-chain")


@register("stream_latest_triples", with_ctes(
    "SELECT s, p, arg_max(o, (timestamp, o)) AS o, max(timestamp) AS timestamp"
    " FROM triples GROUP BY s, p", "triples"))
def q_stream_latest(spark, sf):
    st = S.map_stream(telemetry_wide(_events_stream(spark, sf)), telemetry_mapping())
    base = S.checkpoint_path(spark, "latest")
    q = S.latest_stream(st, f"{base}/snap", f"{base}/_ckpt", available_now=True)
    q.awaitTermination()
    return read_snapshot(spark, f"{base}/snap")


@register("stream_dead_letter", with_ctes(
    "SELECT event_id, '{\"tagPath\":\"' || tag_path || '\",' AS line FROM payload WHERE corrupt",
    "payload"))
def q_stream_dead(spark, sf):
    lines = tag_payload_lines(_events_stream(spark, sf))
    base = S.checkpoint_path(spark, "deadletter")
    q = S.dead_letter_stream(lines, f"{base}/good", f"{base}/dead", f"{base}/_ckpt",
                             available_now=True)
    q.awaitTermination()
    return spark.read.schema("event_id bigint, line string").option("recursiveFileLookup", "true") \
        .parquet(f"{base}/dead")


@register("stream_ingest_metrics", with_ctes(
    "SELECT count(*) AS received, count_if(contains(lower(quality), 'good')) AS good, count_if(coalesce(numeric_value > 250, false)) AS dropped,"
    " count_if(NOT coalesce(numeric_value > 250, false) AND data_type = 'BOOLEAN') AS filtered,"
    " count_if(NOT coalesce(numeric_value > 250, false) AND data_type <> 'BOOLEAN') AS accepted, 4 AS epochs FROM ot_events", "ot_events"))
def q_stream_metrics(spark, sf):
    """Counts per epoch in a table, over two runs of one query that together read four steps of files."""
    base = S.checkpoint_path(spark, "metrics")
    listener = MetricsListener(spark, f"{base}/metrics")
    spark.streams.addListener(listener)
    try:
        parts = table(spark, sf, "events").withColumn("_f", F.pmod(F.xxhash64("event_id"), F.lit(4)))
        write, files = _fed(parts, base)
        for run in (0, 1):
            for f in (2 * run, 2 * run + 1):
                write(f)
            events = S.stream_table(spark, f"{base}/in/*", max_files_per_trigger=files)
            seen = S.observe_ingest(ot_events_from(events).withColumn("over", F.col("numeric_value") > 250).withColumn("same", F.col("data_type") == "BOOLEAN"),
                                    dropped="over", filtered="same")
            q = S.write_append(seen, f"{base}/out", f"{base}/ckpt", available_now=True)
            q.awaitTermination()
            listener.flush(q)
    finally:
        spark.streams.removeListener(listener)
    return total_metrics(read_metrics(spark, f"{base}/metrics")).drop("query")


@register("stream_deadband_ordered", with_ctes(
    f"SELECT {OT_COLS} FROM fev JOIN fold USING (tag_path, rn) WHERE keep"
    " AND event_time < (SELECT max(event_time) FROM ot_events) - INTERVAL 3 DAYS", "ot_events",
    extra=fold_sql("ot_events", 50.0), recursive=True))
def q_stream_deadband_ordered(spark, sf):
    """Events up to two days out of order in four files: what the batch deadband keeps, as far as the watermark came."""
    base = S.checkpoint_path(spark, "ordered")
    late = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(2 * 86400))
    parts = table(spark, sf, "events").withColumn("_f", F.least(F.lit(3), F.floor((late - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))) / (8 * 86400))))
    write, files = _fed(parts, base)
    for f in range(4):                                   # one after the other: files are read in order of their time
        write(f, lambda df, n: df.repartition(n).sortWithinPartitions(F.xxhash64("event_id", F.lit(1))))
    events = ot_events_from(S.stream_table(spark, f"{base}/in/*", max_files_per_trigger=files))
    q = S.write_append(ordered_deadband_stream(events, 50.0, "3 days"), f"{base}/out", f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/out")


@register("stream_rate_cap", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events QUALIFY row_number() OVER (PARTITION BY date_trunc('hour', make_timestamp(ingestion_timestamp))"
    " ORDER BY ingestion_timestamp, event_id) <= 3", "ot_events"))
def q_stream_rate_cap(spark, sf):
    """Three events an hour pass, over four files in order of time; an hour that two files share is counted on."""
    base = S.checkpoint_path(spark, "cap")
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400 - 0.3)
    parts = table(spark, sf, "events").withColumn("_f", F.least(F.lit(3), F.floor((day - F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) / 86400) / 8)))
    for f in range(4):
        parts.where(F.greatest(F.col("_f"), F.lit(0)) == f).drop("_f").coalesce(1).write.parquet(f"{base}/in/{f}")
    events = ot_events_from(S.stream_table(spark, f"{base}/in/*", max_files_per_trigger=1))
    capped = rate_cap_stream(events.withColumn("ingest_ts", F.timestamp_micros("ingestion_timestamp")), 3, unit="hour", delay="2 hours")
    q = S.write_append(capped, f"{base}/out", f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{base}/out")
