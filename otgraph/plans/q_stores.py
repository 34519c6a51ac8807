"""Registered queries over tables that are kept current by commits (``sources.latest_store``, ``sources.history``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from otgraph.plans.adapters import table, telemetry_mapping, telemetry_wide, triples, with_ctes
from otgraph.plans.catalog import register
from otgraph.sources.history import TripleHistory
from otgraph.sources.latest_store import LatestStore
from otgraph.streaming import ingest as S


@register("latest_store", with_ctes(
    "SELECT s, p, arg_max(o, (timestamp, o)) AS o, max(timestamp) AS timestamp FROM triples GROUP BY s, p", "triples"))
def q_latest_store(spark, sf):
    """The events arrive as four micro-batches; each writes the buckets it touches."""
    base = S.checkpoint_path(spark, "latest-store")
    table(spark, sf, "events").repartitionByRange(4, "event_id").write.parquet(f"{base}/in")
    stream = S.map_stream(telemetry_wide(S.stream_table(spark, f"{base}/in", max_files_per_trigger=1)), telemetry_mapping())
    store = LatestStore(spark, f"{base}/table", buckets=16)
    S.latest_store_stream(stream, store, f"{base}/ckpt", available_now=True).awaitTermination()
    return store.read()


_INSTANTS = ["2024-01-02 00:00:00", "2024-01-10 13:30:00", "2024-01-15 00:00:00", "2024-02-20 00:00:00"]


@register("history_pit", with_ctes(" UNION ALL ".join(
    f"SELECT '{t}' AS instant, s, p, o, timestamp FROM (SELECT * FROM triples WHERE timestamp < TIMESTAMP '{t}'"
    " QUALIFY row_number() OVER (PARTITION BY s, p ORDER BY timestamp DESC, o DESC) = 1)" for t in _INSTANTS), "triples"))
def q_history_pit(spark, sf):
    """Points in time from day checkpoints; a tenth of the events arrives late, after the checkpoints were made."""
    history = TripleHistory(spark, f"{S.checkpoint_path(spark, 'history')}/table")
    rows = triples(table(spark, sf, "events"))
    late = F.pmod(F.xxhash64("s", "p", "o", "timestamp"), F.lit(10)) == 0
    history.append(rows.where(~late))
    history.append(rows.where(late))
    return reduce(lambda a, b: a.unionByName(b), [history.at(t).select(F.lit(t).alias("instant"), "s", "p", "o", "timestamp") for t in _INSTANTS])
