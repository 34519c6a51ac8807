"""Streaming ingest: sources, append sinks, replay dedupe, dead letters, ingest metrics,
latest-snapshot maintenance, windowed rollups (S5, S6, S8, M2, T1, T2, T4-T7).

Sinks are checkpointed: the file sink commits each micro-batch in its own log, so a restarted
query neither loses nor duplicates output (at-least-once delivery from the source, exactly-once
files). Checkpoints belong in shared storage; ``checkpoint_path`` builds them under the
session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from otgraph.operators.mapping import TripleMapping
from otgraph.operators.silver import rollup_merge, rollup_state, rollup_values
from otgraph.operators.triples import latest_triples
from otgraph.schemas import TELEMETRY
from otgraph.session import ensure_checkpoint_dir
from otgraph.sources.events import parse_tag_payloads, split_corrupt
from otgraph.sources.latest_store import LatestStore
from otgraph.sources.sinks import has_snapshot, read_snapshot, write_snapshot

__all__ = ["checkpoint_path", "stream_telemetry", "stream_tag_payloads", "stream_table",
           "map_stream", "write_append", "dedupe_events", "dead_letter_stream",
           "observe_ingest", "latest_stream", "latest_store_stream", "rollup_stream", "rollup_chain_stream", "run_available"]


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one query under the session's checkpoint root."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def stream_telemetry(spark: SparkSession, path: str, fmt: str = "parquet",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Continuous telemetry batches from a folder, fixed schema."""
    r = spark.readStream.schema(TELEMETRY).format(fmt)
    if fmt == "csv":
        r = r.option("header", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def stream_tag_payloads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, dead letters) from JSON payload lines arriving in a folder."""
    lines = spark.readStream.text(path).withColumnRenamed("value", "line")
    good, dead = split_corrupt(lines)
    return parse_tag_payloads(good, parsed="_v"), dead


def stream_table(spark: SparkSession, path: str, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Any table folder (or a glob of files) as a stream with the schema of its batch read."""
    schema = spark.read.format(fmt).load(path).schema
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def map_stream(stream: DataFrame, mapping: TripleMapping) -> DataFrame:
    """Row → triple mapping on a stream (M2): the batch transform is stateless, so it is the
    same plan."""
    return mapping.apply(stream)


def write_append(stream: DataFrame, path: str, checkpoint: str, every: str | None = "2 seconds",
                 fmt: str = "parquet", partition_by: tuple[str, ...] = (),
                 available_now: bool = False) -> StreamingQuery:
    """Append micro-batches to a file table."""
    w = stream.writeStream.format(fmt).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if available_now:
        w = w.trigger(availableNow=True)
    elif every:
        w = w.trigger(processingTime=every)
    return w.start(path)


def dedupe_events(stream: DataFrame, within: str = "10 minutes", ts: str = "event_time",
                  key: str = "event_id") -> DataFrame:
    """Drop replays of an event id seen within the watermark delay."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def dead_letter_stream(lines: DataFrame, good_path: str, dead_path: str, checkpoint: str,
                       available_now: bool = False) -> StreamingQuery:
    """Write parsed events and unparsable lines to two sinks from one query (T6). Each epoch owns
    one folder per sink (``epoch=<n>``) and overwrites it, so a replayed epoch changes nothing."""
    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            good, dead = split_corrupt(df)
            parse_tag_payloads(good, parsed="_v").write.mode("overwrite").parquet(f"{good_path.rstrip('/')}/epoch={epoch}")
            dead.write.mode("overwrite").parquet(f"{dead_path.rstrip('/')}/epoch={epoch}")
        finally:
            df.unpersist()

    w = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def observe_ingest(stream: DataFrame, name: str = "ingest", quality: str = "quality",
                   dropped: str | None = None, filtered: str | None = None) -> DataFrame:
    """Per-batch counts reported in the query progress (T7): received and good quality, and, from
    boolean columns that mark rows over the rate cap and rows the change filter removes, dropped,
    filtered and accepted."""
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False)) if c else F.lit(False)
    over, same = is_(dropped), is_(filtered)
    return stream.observe(name, F.count(F.lit(1)).alias("received"),
                          F.count_if(F.lower(F.col(quality)).contains("good")).alias("good"),
                          F.count_if(over).alias("dropped"), F.count_if(~over & same).alias("filtered"),
                          F.count_if(~over & ~same).alias("accepted"))


def latest_stream(triples: DataFrame, base: str, checkpoint: str,
                  available_now: bool = False) -> StreamingQuery:
    """Keep the newest triple per (s, p) current (T5): each micro-batch is merged with the
    previous snapshot and written as a fresh version. Only a missing pointer means there is no
    snapshot yet; a snapshot that cannot be read fails the batch. A replayed epoch merges rows that
    are in the snapshot already, which changes nothing."""
    def batch(df: DataFrame, _epoch: int) -> None:
        if has_snapshot(df.sparkSession, base):
            prev = read_snapshot(df.sparkSession, base)
            df = prev.unionByName(df.select(*prev.columns))
        write_snapshot(latest_triples(df), base)

    w = triples.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def latest_store_stream(triples: DataFrame, store: LatestStore, checkpoint: str, origin: str = "stream",
                        available_now: bool = False) -> StreamingQuery:
    """Keep a bucketed store current (T5): a micro-batch writes the buckets it touches and nothing else. A replayed
    epoch is recognised by its number and skipped."""
    w = triples.writeStream.foreachBatch(lambda df, epoch: store.merge(df, origin, epoch) and None).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


def rollup_stream(stream: DataFrame, every: str = "1 minute", watermark: str = "10 minutes",
                  ts: str = "event_time", keys: tuple[str, ...] = ("asset_id", "signal_name"),
                  value: str = "value_numeric") -> DataFrame:
    """Tumbling-window rollups emitted once the watermark passes the window end (T4)."""
    return (stream.filter(F.col(value).isNotNull()).withWatermark(ts, watermark)
            .groupBy(F.window(F.col(ts), every).alias("w"), *keys)
            .agg(F.avg(value).alias("avg_value"), F.min(value).alias("min_value"),
                 F.max(value).alias("max_value"), F.max_by(value, F.struct(ts, value)).alias("last_value"),
                 F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("bucket_start"), *keys, "avg_value", "min_value",
                    "max_value", "last_value", "n"))


def rollup_chain_stream(stream: DataFrame, sizes: Sequence[str], watermark: str = "10 minutes", ts: str = "event_time",
                        **names) -> DataFrame:
    """Rollups of the last of ``sizes`` on a stream, fed by those of the next smaller size and so on down to the rows
    (T4): chained stateful windows, each emitting a bucket when the watermark passes its end. The state of
    the larger sizes holds a row per smaller bucket's key, never rows."""
    state = rollup_state(stream.withWatermark(ts, watermark), sizes[0], ts=ts, **names)
    keys = names.get("keys", ("asset_id", "signal_name"))
    for size in sizes[1:]:
        state = rollup_merge(state, size, keys)
    return rollup_values(state, keys)


def run_available(stream: DataFrame, spark: SparkSession, name: str,
                  output_mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a parquet sink under the checkpoint root
    and return the sink as a batch DataFrame (used to prove stream = batch)."""
    root = checkpoint_path(spark, name)
    q = (stream.writeStream.format("parquet").outputMode(output_mode)
         .option("checkpointLocation", f"{root}/_ckpt").trigger(availableNow=True)
         .start(f"{root}/out"))
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")
