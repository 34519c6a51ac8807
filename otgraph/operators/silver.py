"""Silver layer: normalisation against the signal mapping, asset enrichment, counts, ingest
metrics, signal rollups and latest signal values (J1, J2, A4, A6, A8, A9).

Mapping and registry are dimensions keyed by tag / asset. No broadcast hint is forced on them:
the planner broadcasts a side only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks with the real shuffle size), otherwise
the join stays a sort-merge join — the size check and its fallback are Spark's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otgraph.functions.events import scale_offset
from otgraph.operators.triples import latest_by

NORMALIZED_COLUMNS = ["event_time", "ingestion_timestamp", "source_system", "asset_id",
                      "signal_name", "unit", "value_numeric", "string_value", "quality",
                      "quality_code", "tag_path"]


def normalize_events(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events left-joined to the *active* mappings of their tag.

    ``active`` is part of the join condition, so an event whose mappings are all inactive is
    kept with NULL signal columns; two active mappings of one tag give two rows.
    """
    m = mapping.filter(F.col("active") == F.lit(True)).select(
        F.col("tag_path").alias("_m_tag"), "asset_id", "signal_name", "unit", "scale", "offset")
    j = events.join(m, events["tag_path"] == m["_m_tag"], "left")
    return j.select(
        "event_time", "ingestion_timestamp", "source_system", "asset_id", "signal_name", "unit",
        scale_offset("numeric_value", "boolean_value", "scale", "offset").alias("value_numeric"),
        "string_value", "quality", "quality_code", events["tag_path"],
    )


def with_asset(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Left join of asset attributes on ``asset_id``."""
    r = registry.select("asset_id", "asset_type", "site", "display_name",
                        F.col("active").alias("asset_active"))
    return df.join(r, on="asset_id", how="left")


def event_counts(df: DataFrame, keys: Sequence[str], now, interval: str = "2 minutes",
                 ingest_col: str = "ingestion_timestamp") -> DataFrame:
    """Recent event count and last ingest time per key (A4). ``ingest_col`` holds epoch µs."""
    now_c = now if isinstance(now, Column) else F.to_timestamp(F.lit(str(now)))
    ts = F.timestamp_micros(F.col(ingest_col))
    # the stored epoch is compared with an epoch literal, so the filter reaches the scan
    return (
        df.filter(F.col(ingest_col) >= F.unix_micros(now_c - F.expr(f"INTERVAL {interval}")))
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("events"), F.max(ts).alias("last_ingested_at"))
    )


def ingest_metrics(received: DataFrame, after_cap: DataFrame, accepted: DataFrame,
                   keys: Sequence[str]) -> DataFrame:
    """received / dropped (rate cap) / filtered (change filter) / accepted per key."""
    stage = "_stage"
    u = (received.select(*keys, F.lit(0).alias(stage))
         .unionByName(after_cap.select(*keys, F.lit(1).alias(stage)))
         .unionByName(accepted.select(*keys, F.lit(2).alias(stage))))
    agg = u.groupBy(*keys).agg(
        F.count_if(F.col(stage) == 0).alias("received"),
        F.count_if(F.col(stage) == 1).alias("_capped"),
        F.count_if(F.col(stage) == 2).alias("accepted"),
    )
    return agg.select(*keys, "received",
                      (F.col("received") - F.col("_capped")).alias("dropped"),
                      (F.col("_capped") - F.col("accepted")).alias("filtered"), "accepted")


def rollup_signals(df: DataFrame, every: str = "1 minute", ts: str = "event_time",
                   keys: Sequence[str] = ("asset_id", "signal_name"),
                   value: str = "value_numeric", tie: str = "ingestion_timestamp") -> DataFrame:
    """avg / min / max / last / count per key and tumbling bucket.

    Partial aggregation runs before the shuffle; ``last`` is the value of the newest event.
    """
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.window(F.col(ts), every).alias("w"), *keys)
        .agg(F.avg(value).alias("avg_value"), F.min(value).alias("min_value"),
             F.max(value).alias("max_value"),
             F.max(F.struct(F.col(ts), F.col(tie), F.col(value)))[value].alias("last_value"),
             F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("bucket_start"), *keys, "avg_value", "min_value",
                "max_value", "last_value", "n")
    )


def rollup_state(df: DataFrame, every: str, ts: str = "event_time", keys: Sequence[str] = ("asset_id", "signal_name"),
                 value: str = "value_numeric", tie: str = "ingestion_timestamp") -> DataFrame:
    """Mergeable state per key and tumbling bucket of ``every``: keys, window ``w``, ``total``, ``n``, ``least``, ``most`` and
    ``last`` (time, tie, value). Sums of sums, greatest of greatest and so on give the states of larger
    buckets (``rollup_merge``), so raw rows are read once for all sizes."""
    return (df.filter(F.col(value).isNotNull()).groupBy(F.window(F.col(ts), every).alias("w"), *keys)
            .agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"),
                 F.max(F.struct(F.col(ts).alias("t"), F.col(tie).alias("tie"), F.col(value).alias("v"))).alias("last")))


def rollup_merge(state: DataFrame, every: str, keys: Sequence[str] = ("asset_id", "signal_name")) -> DataFrame:
    """The states of buckets of ``every`` from those of smaller ones that divide it. Works on streams too: the
    window of a state carries its event time on."""
    return (state.groupBy(F.window(F.window_time("w"), every).alias("w"), *keys)
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"),
                 F.max("last").alias("last")))


def rollup_values(state: DataFrame, keys: Sequence[str] = ("asset_id", "signal_name")) -> DataFrame:
    """bucket_start, keys, avg, min, max, last and count of a state, as ``rollup_signals`` gives them."""
    return state.select(F.col("w.start").alias("bucket_start"), *keys, (F.col("total") / F.col("n")).alias("avg_value"),
                        F.col("least").alias("min_value"), F.col("most").alias("max_value"), F.col("last.v").alias("last_value"), "n")


def rollup_chain(df: DataFrame, sizes: Sequence[str], **names) -> dict[str, DataFrame]:
    """States of all ``sizes`` (ascending, each a multiple of the one before), every size from the next smaller one."""
    keys = names.get("keys", ("asset_id", "signal_name"))
    out = {sizes[0]: rollup_state(df, sizes[0], **names)}
    for small, large in zip(sizes, sizes[1:]):
        out[large] = rollup_merge(out[small], large, keys)
    return out


def latest_signals(df: DataFrame, keys: Sequence[str] = ("asset_id", "signal_name"),
                   ts: str = "event_time", values: Sequence[str] = ("value_numeric",),
                   tie: Sequence[str] = ("ingestion_timestamp",)) -> DataFrame:
    """Newest normalised value per asset and signal."""
    return latest_by(df, list(keys), ts, list(values), tie=list(tie))


def top_sources(counts: DataFrame, n: int, count_col: str = "events",
                last_col: str = "last_ingested_at") -> DataFrame:
    """The ``n`` busiest sources, most events first, then most recent ingest (L2). A top-k
    report: Spark plans it as TakeOrderedAndProject (per-task top n, then a merge)."""
    return counts.orderBy(F.col(count_col).desc(), F.col(last_col).desc()).limit(int(n))
