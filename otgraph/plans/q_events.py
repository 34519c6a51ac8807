"""Registered queries over tag payloads and OT events."""

from __future__ import annotations

from pyspark.sql import functions as F

from otgraph.operators import changes as C
from otgraph.operators import select as S
from otgraph.operators import silver as V
from otgraph.plans.adapters import (NOW, fold_sql, ot_events_from, table, tag_dimensions,
                                    tag_payload_lines, with_ctes)
from otgraph.plans.catalog import register
from otgraph.sources.events import split_corrupt

OT_COLS = ("event_id, event_time, tag_path, tag_provider, numeric_value, string_value, "
           "boolean_value, quality, quality_code, source_system, ingestion_timestamp, data_type, "
           "alarm_state, alarm_priority")
NORM_COLS = ("event_time, ingestion_timestamp, source_system, asset_id, signal_name, unit, "
             "value_numeric, string_value, quality, quality_code, tag_path")


def _ot(spark, sf):
    return ot_events_from(table(spark, sf, "events"))


def _dims(spark, sf):
    return tag_dimensions(table(spark, sf, "events"))


@register("payload_ot_events", with_ctes(f"SELECT {OT_COLS} FROM ot_events", "ot_events"))
def q_payload_ot_events(spark, sf):
    return _ot(spark, sf)


@register("dead_letter", with_ctes(
    "SELECT event_id, '{\"tagPath\":\"' || tag_path || '\",' AS line FROM payload WHERE corrupt",
    "payload"))
def q_dead_letter(spark, sf):
    _good, dead = split_corrupt(tag_payload_lines(table(spark, sf, "events")))
    return dead


@register("normalize_events", with_ctes(f"SELECT {NORM_COLS} FROM normalized", "normalized"))
def q_normalize(spark, sf):
    mapping, _reg = _dims(spark, sf)
    return V.normalize_events(_ot(spark, sf), mapping)


@register("normalize_with_asset", with_ctes(
    f"SELECT n.*, r.asset_type, r.site, r.display_name, r.active AS asset_active"
    " FROM normalized n LEFT JOIN asset_registry r USING (asset_id)",
    "normalized", "asset_registry"))
def q_with_asset(spark, sf):
    mapping, reg = _dims(spark, sf)
    return V.with_asset(V.normalize_events(_ot(spark, sf), mapping), reg)


@register("select_explicit", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events WHERE tag_path IN"
    " (SELECT trim(tag_path) FROM signal_mapping WHERE active)", "ot_events", "signal_mapping"))
def q_select_explicit(spark, sf):
    mapping, _reg = _dims(spark, sf)
    return S.select_explicit(_ot(spark, sf), mapping.filter("active").select("tag_path"))


@register("select_folder_recursive", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events WHERE starts_with(tag_path, '[view]Site/')", "ot_events"))
def q_select_folder_rec(spark, sf):
    return S.select_folder(_ot(spark, sf), "[view]Site", recursive=True)


@register("select_folder_direct", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events WHERE starts_with(tag_path, 'Site/L1/')"
    " AND NOT contains(substr(tag_path, 9), '/')", "ot_events"))
def q_select_folder_direct(spark, sf):
    return S.select_folder(_ot(spark, sf), "Site/L1", recursive=False)


_PATTERN = r"\[(signup|purchase)\]Site/L[01]/U[0-9]*1/.*"


@register("select_pattern", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events WHERE regexp_full_match(tag_path, '{_PATTERN}')",
    "ot_events"))
def q_select_pattern(spark, sf):
    return S.select_pattern(_ot(spark, sf), _PATTERN)


@register("only_on_change", with_ctes(
    f"SELECT {OT_COLS} FROM fev JOIN fold USING (tag_path, rn) WHERE keep", "ot_events",
    extra=fold_sql("ot_events", 0.0), recursive=True))
def q_only_on_change(spark, sf):
    return C.only_on_change(_ot(spark, sf))


@register("deadband", with_ctes(
    f"SELECT {OT_COLS} FROM fev JOIN fold USING (tag_path, rn) WHERE keep", "ot_events",
    extra=fold_sql("ot_events", 50.0), recursive=True))
def q_deadband(spark, sf):
    return C.deadband(_ot(spark, sf), 50.0)


_INGEST_SQL = "make_timestamp(ingestion_timestamp)"


@register("rate_cap", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events QUALIFY row_number() OVER ("
    f"PARTITION BY date_trunc('hour', {_INGEST_SQL}) ORDER BY {_INGEST_SQL}, event_id) <= 3",
    "ot_events"))
def q_rate_cap(spark, sf):
    ot = _ot(spark, sf).withColumn("ingest_ts", F.timestamp_micros("ingestion_timestamp"))
    return C.rate_cap(ot, 3, ts="ingest_ts", unit="hour").drop("ingest_ts")


@register("drop_initial", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events QUALIFY row_number() OVER ("
    "PARTITION BY tag_path ORDER BY event_time, event_id) > 1", "ot_events"))
def q_drop_initial(spark, sf):
    # the subscription's initial value stands for each tag's first event: found with a
    # partially aggregated min per tag (no window over a whole tag), flagged by a left join
    ot = _ot(spark, sf)
    first = ot.groupBy("tag_path").agg(F.min(F.struct("event_time", "event_id")).alias("_f")) \
        .select("tag_path", F.col("_f.event_time").alias("_ft"), F.col("_f.event_id").alias("_fid"),
                F.lit(True).alias("is_initial"))
    flagged = ot.join(first, (ot["tag_path"] == first["tag_path"])
                      & (ot["event_time"] == first["_ft"]) & (ot["event_id"] == first["_fid"]),
                      "left").select(ot["*"], F.coalesce(F.col("is_initial"), F.lit(False))
                                     .alias("is_initial"))
    return S.drop_initial(flagged).drop("is_initial")


@register("recent_events", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events WHERE event_time >= TIMESTAMP '{NOW}' - INTERVAL 2 DAYS",
    "ot_events"))
def q_recent(spark, sf):
    return S.recent(_ot(spark, sf), "event_time", "2 DAYS", NOW)


@register("good_quality", with_ctes(
    f"SELECT {OT_COLS} FROM ot_events WHERE contains(lower(quality), 'good')", "ot_events"))
def q_good(spark, sf):
    return S.good_quality(_ot(spark, sf))


@register("event_counts", with_ctes(
    "SELECT source_system, tag_provider, count(*) AS events,"
    f" max({_INGEST_SQL}) AS last_ingested_at FROM ot_events"
    f" WHERE {_INGEST_SQL} >= TIMESTAMP '{NOW}' - INTERVAL 2 DAYS"
    " GROUP BY source_system, tag_provider", "ot_events"))
def q_event_counts(spark, sf):
    return V.event_counts(_ot(spark, sf), ["source_system", "tag_provider"], NOW, "2 days")


@register("ingest_metrics", with_ctes(
    "SELECT r.tag_provider, r.received, r.received - coalesce(c.n, 0) AS dropped,"
    " coalesce(c.n, 0) - coalesce(a.n, 0) AS filtered, coalesce(a.n, 0) AS accepted"
    " FROM (SELECT tag_provider, count(*) AS received FROM ot_events GROUP BY 1) r"
    " LEFT JOIN (SELECT tag_provider, count(*) AS n FROM capped GROUP BY 1) c USING (tag_provider)"
    " LEFT JOIN (SELECT tag_provider, count(*) AS n FROM fev JOIN fold USING (tag_path, rn)"
    "  WHERE keep GROUP BY 1) a USING (tag_provider)", "ot_events",
    extra=f"capped AS (SELECT * FROM ot_events QUALIFY row_number() OVER (PARTITION BY"
          f" date_trunc('hour', {_INGEST_SQL}) ORDER BY {_INGEST_SQL}, event_id) <= 3),"
          + fold_sql("capped", 0.0), recursive=True))
def q_ingest_metrics(spark, sf):
    ot = _ot(spark, sf)
    capped = C.rate_cap(ot.withColumn("ingest_ts", F.timestamp_micros("ingestion_timestamp")),
                        3, ts="ingest_ts", unit="hour").drop("ingest_ts")
    kept = C.only_on_change(capped)
    return V.ingest_metrics(ot, capped, kept, ["tag_provider"])


@register("rollup_signals", with_ctes(
    "SELECT time_bucket(INTERVAL 1 HOUR, event_time) AS bucket_start, asset_id, signal_name,"
    " avg(value_numeric) AS avg_value, min(value_numeric) AS min_value,"
    " max(value_numeric) AS max_value,"
    " arg_max(value_numeric, (event_time, ingestion_timestamp, value_numeric)) AS last_value,"
    " count(*) AS n FROM normalized WHERE value_numeric IS NOT NULL GROUP BY ALL", "normalized"), rounded=('avg_value',))
def q_rollup(spark, sf):
    mapping, _reg = _dims(spark, sf)
    return V.rollup_signals(V.normalize_events(_ot(spark, sf), mapping), "1 hour")


_SIZES = {"5 minutes": "INTERVAL 5 MINUTES", "1 hour": "INTERVAL 1 HOUR", "1 day": "INTERVAL 1 DAY"}


@register("rollup_chain", with_ctes(" UNION ALL ".join(
    f"SELECT '{size}' AS size, time_bucket({step}, event_time) AS bucket_start, asset_id, signal_name, avg(value_numeric) AS avg_value,"
    " min(value_numeric) AS min_value, max(value_numeric) AS max_value,"
    " arg_max(value_numeric, (event_time, ingestion_timestamp, value_numeric)) AS last_value, count(*) AS n"
    " FROM normalized WHERE value_numeric IS NOT NULL GROUP BY ALL" for size, step in _SIZES.items()), "normalized"), rounded=('avg_value',))
def q_rollup_chain(spark, sf):
    """5 minutes from the rows, 1 hour from 5 minutes, 1 day from 1 hour."""
    mapping, _reg = _dims(spark, sf)
    states = V.rollup_chain(V.normalize_events(_ot(spark, sf), mapping), list(_SIZES))
    parts = [V.rollup_values(st).withColumn("size", F.lit(size)) for size, st in states.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("latest_signals", with_ctes(
    "SELECT asset_id, signal_name, event_time, value_numeric FROM normalized"
    " QUALIFY row_number() OVER (PARTITION BY asset_id, signal_name"
    " ORDER BY event_time DESC, ingestion_timestamp DESC, value_numeric DESC NULLS LAST) = 1",
    "normalized"))
def q_latest_signals(spark, sf):
    mapping, _reg = _dims(spark, sf)
    return V.latest_signals(V.normalize_events(_ot(spark, sf), mapping))


@register("top_sources", with_ctes(
    "SELECT source_system, tag_provider, count(*) AS events,"
    f" max({_INGEST_SQL}) AS last_ingested_at FROM ot_events"
    " GROUP BY source_system, tag_provider ORDER BY events DESC, last_ingested_at DESC LIMIT 3",
    "ot_events"))
def q_top_sources(spark, sf):
    counts = V.event_counts(_ot(spark, sf), ["source_system", "tag_provider"], NOW, "3650 days")
    return V.top_sources(counts, 3)


@register("deadband_daily", with_ctes(
    f"SELECT {OT_COLS} FROM fev JOIN fold USING (tag_path, rn) WHERE keep", "ot_events",
    extra=fold_sql("ot_events", 12.5), recursive=True))
def q_deadband_daily(spark, sf):
    """A narrower deadband, each tag split by hour."""
    return C.deadband(_ot(spark, sf), 12.5, split_by="hour")
