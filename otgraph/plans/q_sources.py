"""Registered queries for bronze coercion, partial inserts, the bronze → triples mapping and
N-Triples output."""

from __future__ import annotations

from pyspark.sql import functions as F

from otgraph.functions.iri import predicate_iri
from otgraph.operators.triples import point_in_time
from otgraph.plans.adapters import NS, PIT_AT, register_cte, table, triples, with_ctes
from otgraph.plans.catalog import register
from otgraph.schemas import TELEMETRY_SENSORS
from otgraph.sources.events import read_ot_events, write_ot_events
from otgraph.sources.sinks import ntriples_lines, read_snapshot, sync_latest
from otgraph.sources.telemetry import append_telemetry, read_telemetry
from otgraph.streaming.ingest import checkpoint_path, stream_telemetry, write_append
from otgraph.plans.adapters import ot_events_from
from otgraph.plans.q_events import OT_COLS
from otgraph.sources.files import load_tag_tree, template_fields
from otgraph.sources.telemetry import TS_FORMAT, coerce_telemetry, partial_rows, read_legacy_csv, telemetry_mapping

# sensor column ← event type
_RAW = {"oil_temperature": "signup", "water_temperature": "view", "belt_speed": "purchase",
        "freezer_temperature": "click", "moisture_content": "error"}


def raw_bronze(events):
    et, v = F.col("event_type"), F.col("value")
    return events.select(
        *[F.when(et == t, v).alias(c) for c, t in _RAW.items()],
        F.lit(None).alias("product_weight"), v.alias("component_yield_output"),
        F.col("ts").alias("timestamp"), F.col("user_id").alias("component_id"),
        et.alias("stage_id"), (v > 300).cast("int").alias("damaged_component"),
        F.when(v < 5, F.lit("belt_speed")).alias("abnormal_sensor"),
        (F.col("user_id") % 3).alias("line_id"))


register_cte("bronze", "SELECT " + ", ".join(
    f"CASE WHEN event_type = '{t}' THEN value END AS {c}" for c, t in _RAW.items())
    + ", CAST(NULL AS DOUBLE) AS product_weight, value AS component_yield_output,"
      " strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS timestamp, CAST(user_id AS VARCHAR) AS component_id,"
      " event_type AS stage_id, value > 300 AS damaged_component,"
      " coalesce(CASE WHEN value < 5 THEN 'belt_speed' END, '') AS abnormal_sensor,"
      " CAST(user_id % 3 AS VARCHAR) AS line_id FROM events")


@register("coerce_telemetry", with_ctes("SELECT * FROM bronze", "bronze"))
def q_coerce(spark, sf):
    return coerce_telemetry(raw_bronze(table(spark, sf, "events")))


_PREDS = [(predicate_iri(s), s) for s in TELEMETRY_SENSORS]


@register("bronze_triples", with_ctes(" UNION ALL ".join(
    [f"SELECT '{NS}/component-' || component_id AS s, 'rdf:type' AS p, '{NS}/type/component' AS o,"
     " CAST(timestamp AS TIMESTAMP) AS timestamp FROM bronze"]
    + [f"SELECT '{NS}/component-' || component_id, '{p}', CAST({c} AS VARCHAR),"
       f" CAST(timestamp AS TIMESTAMP) FROM bronze WHERE {c} IS NOT NULL" for p, c in _PREDS]
    + [f"SELECT '{NS}/component-' || component_id, '{predicate_iri('damaged_component')}',"
       " CAST(damaged_component AS VARCHAR), CAST(timestamp AS TIMESTAMP) FROM bronze",
       f"SELECT '{NS}/component-' || component_id, '{predicate_iri('abnormal_sensor')}',"
       " abnormal_sensor, CAST(timestamp AS TIMESTAMP) FROM bronze"]), "bronze"))
def q_bronze_triples(spark, sf):
    bronze = coerce_telemetry(raw_bronze(table(spark, sf, "events")))
    return telemetry_mapping().apply(bronze)


@register("partial_rows", with_ctes(
    "SELECT CAST(NULL AS DOUBLE) AS component_yield_output, CAST(NULL AS BOOLEAN) AS"
    " damaged_component, CAST(NULL AS VARCHAR) AS abnormal_sensor, CAST(NULL AS DOUBLE) AS"
    " moisture_content, CAST(NULL AS DOUBLE) AS product_weight, component_id, line_id, stage_id,"
    " oil_temperature, water_temperature, belt_speed, freezer_temperature, timestamp FROM bronze",
    "bronze"))
def q_partial(spark, sf):
    b = coerce_telemetry(raw_bronze(table(spark, sf, "events")))
    return partial_rows(b.select("component_id", "line_id", "stage_id", "oil_temperature",
                                 "water_temperature", "belt_speed", "freezer_temperature",
                                 "timestamp"))


@register("ntriples", with_ctes(
    "SELECT '<' || s || '> ' || CASE WHEN p = 'rdf:type' THEN"
    " '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <' || o || '>'"
    " ELSE '<' || p || '> \"' || o || '\"' END || ' .' AS value FROM ("
    " SELECT s, p, o FROM triples WHERE timestamp < TIMESTAMP '" + PIT_AT + "'"
    " QUALIFY row_number() OVER (PARTITION BY s, p ORDER BY timestamp DESC, o DESC) = 1)",
    "triples"))
def q_ntriples(spark, sf):
    return ntriples_lines(point_in_time(triples(table(spark, sf, "events")), PIT_AT))


# The round trips below write under the session's checkpoint root and read the result back.

@register("ot_events_roundtrip", with_ctes(f"SELECT {OT_COLS} FROM ot_events", "ot_events"))
def q_ot_roundtrip(spark, sf):
    path = checkpoint_path(spark, "ot-events")
    write_ot_events(ot_events_from(table(spark, sf, "events")), path)
    return read_ot_events(spark, path).select(*OT_COLS.split(", "))


@register("telemetry_roundtrip", with_ctes("SELECT * FROM bronze", "bronze"))
def q_telemetry_roundtrip(spark, sf):
    path = checkpoint_path(spark, "bronze")
    append_telemetry(coerce_telemetry(raw_bronze(table(spark, sf, "events"))), path)
    return read_telemetry(spark, path)


@register("snapshot_latest", with_ctes(
    "SELECT s, p, arg_max(o, (timestamp, o)) AS o, max(timestamp) AS timestamp"
    " FROM triples GROUP BY s, p", "triples"))
def q_snapshot_latest(spark, sf):
    base = checkpoint_path(spark, "latest-snapshot")
    sync_latest(triples(table(spark, sf, "events")), base, version="1")
    return read_snapshot(spark, base)


@register("stream_telemetry_append", with_ctes("SELECT * FROM bronze", "bronze"))
def q_stream_telemetry(spark, sf):
    """Bronze files read as a stream with the fixed schema (S5) and appended to a file table (T1), two files a batch."""
    base = checkpoint_path(spark, "telemetry")
    append_telemetry(coerce_telemetry(raw_bronze(table(spark, sf, "events"))).repartition(4), f"{base}/in")
    q = write_append(stream_telemetry(spark, f"{base}/in", max_files_per_trigger=2), f"{base}/out", f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    return read_telemetry(spark, f"{base}/out")


_LEGACY = {"sensor_rotation": "signup", "sensor_flow": "view", "sensor_temperature": "purchase", "sensor_speed": "click",
           "sensor_vibration": "error"}


@register("legacy_csv", with_ctes(
    "SELECT " + ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {c}" for c, t in _LEGACY.items())
    + ", CAST(NULL AS DOUBLE) AS sensor_pressure, value AS component_yield_output, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS timestamp,"
      " CAST(user_id AS VARCHAR) AS component_id, value > 300 AS damaged_component, CASE WHEN value < 5 THEN 'sensor_flow' ELSE 'None' END AS abnormal_sensor,"
      " 'machine-' || CAST(user_id % 7 AS VARCHAR) AS machine_id, CAST(user_id % 3 AS VARCHAR) AS line_id FROM events", "telemetry"))
def q_legacy_csv(spark, sf):
    """The older column layout written as CSV with a header and read back."""
    path = f"{checkpoint_path(spark, 'legacy')}/csv"
    et, v = F.col("event_type"), F.col("value")
    table(spark, sf, "events").select(
        *[F.when(et == t, v).alias(c) for c, t in _LEGACY.items()], F.lit(None).cast("double").alias("sensor_pressure"),
        v.alias("component_yield_output"), F.date_format("ts", TS_FORMAT).alias("timestamp"), F.col("user_id").cast("string").alias("component_id"),
        (v > 300).alias("damaged_component"), F.when(v < 5, F.lit("sensor_flow")).otherwise("None").alias("abnormal_sensor"),
        F.concat(F.lit("machine-"), F.col("user_id") % 7).alias("machine_id"), (F.col("user_id") % 3).cast("string").alias("line_id"),
    ).write.option("header", "true").csv(path)
    return read_legacy_csv(spark, path)


@register("tag_tree_leaves", with_ctes(
    "SELECT '[L' || CAST(user_id % 3 AS VARCHAR) || ']Plant/U' || CAST(user_id AS VARCHAR) || '/' || event_type AS tag_path,"
    " 'L' || CAST(user_id % 3 AS VARCHAR) AS provider, event_type AS name, 'Int4' AS data_type, 'memory' AS value_source,"
    " CAST(count(*) AS VARCHAR) AS value FROM events GROUP BY user_id, event_type", "telemetry"))
def q_tag_tree(spark, sf):
    """One nested export per provider (line), a folder per user, a tag per event type with its count."""
    path = f"{checkpoint_path(spark, 'tags')}/export"
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    leaf = F.struct(F.col("event_type").alias("name"), F.lit("AtomicTag").alias("tagType"), F.lit("memory").alias("valueSource"),
                    F.lit("Int4").alias("dataType"), F.col("n").alias("value"))
    folder = lambda name, tags: F.struct(name.alias("name"), F.lit("Folder").alias("tagType"), tags.alias("tags"))
    users = n.groupBy("user_id").agg(F.collect_list(leaf).alias("tags"))
    trees = users.groupBy(F.concat(F.lit("L"), F.col("user_id") % 3).alias("provider")).agg(
        F.collect_list(folder(F.concat(F.lit("U"), F.col("user_id")), F.col("tags"))).alias("tags"))
    trees.select("provider", F.to_json(folder(F.lit("Plant"), F.col("tags"))).alias("value")).write.partitionBy("provider").text(path)
    return load_tag_tree(spark, {f"L{i}": f"{path}/provider=L{i}" for i in range(3)})


register_cte("template_files", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'oil_pad' WHEN 1 THEN 'big_factory' WHEN 2 THEN 'solar' ELSE 'drill_RIG' END || '_' || source || '.ttl' AS filename,
  '@prefix ex: <http://e/> .' || chr(10) || '# A prefix line' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '  # Model of ' || source || chr(10) ELSE '' END
  || coalesce(text, '') AS content
FROM documents""")

_WORDS = "lower(replace(replace(filename, '.ttl', ''), '_', ' '))"


@register("template_fields", with_ctes(
    "SELECT doc_id, 'local_' || filename AS id, list_aggregate(list_transform(regexp_extract_all(" + _WORDS + r", '(\p{L}+|[^\p{L}]+)'),"
    " lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS name,"
    " coalesce(substring(trim(list_filter(string_split(content, chr(10)), lambda x: starts_with(trim(x), '# ') AND NOT contains(lower(x), 'prefix'))[1]), 3),"
    " 'Local TTL file template') AS description, CASE WHEN contains(lower(filename), 'oil') OR contains(lower(filename), 'rig') THEN 'oil-gas'"
    " WHEN contains(lower(filename), 'factory') THEN 'manufacturing' ELSE 'template' END AS category, filename FROM template_files",
    "template_files"))
def q_template_fields(spark, sf):
    """Name, description and category of template files (P15); documents stand in for their contents."""
    d = table(spark, sf, "documents")
    kind = F.element_at(F.array(F.lit("oil_pad"), F.lit("big_factory"), F.lit("solar"), F.lit("drill_RIG")), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/models/"), F.col("lang"), F.lit("/"), kind, F.lit("_"), F.col("source"), F.lit(".ttl"))
    content = F.concat(F.lit("@prefix ex: <http://e/> .\n# A prefix line\n"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("  # Model of "), F.col("source"), F.lit("\n"))).otherwise(""),
                       F.coalesce("text", F.lit("")))
    f = template_fields(path, content)
    return d.select("doc_id", *[c.alias(n) for n, c in f.items()])
