"""Driver tables → plant-shaped DataFrames, each with its DuckDB SQL twin.

The benchmark tables carry no plant data, so every registered query first reshapes them with
the same expression in Spark and in SQL:

* ``events`` (event_id, ts, user_id, event_type, value, props) is the telemetry / tag stream:
  a component is a user, each event type is a sensor column of a wide telemetry row.
* TPC-H ``region / nation / customer / supplier / orders`` give the plant graph:
  nation partOf region, customer and supplier locatedIn (a sub-property of partOf) nation,
  orders dependsOn customer; faults propagate region → nation → customer → order.
* ``lineitem`` gives quality data (quantity per part, return flag as reject).
* ``documents`` gives model-registry rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otgraph.functions.iri import DEFAULT_NS, component_iri, predicate_iri, type_iri
from otgraph.operators.mapping import TripleMapping

NS = DEFAULT_NS
# The event types of the driver's events table, used as sensor columns.
SENSORS = ["signup", "view", "purchase", "click", "error"]
# Output names of the four-sensor pivot and the sensors behind them.
PIVOT = {"sensorAReading": "signup", "sensorBReading": "view",
         "sensorCReading": "purchase", "sensorDReading": "click"}
PIT_AT = "2024-01-15 00:00:00"
NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def round_half_even_sql(x: str) -> str:
    """Two places by the exact binary value, ties to even, in whole-number arithmetic."""
    a = f"greatest(abs({x}), 0.0025)"
    unit = f"CAST(pow(2.0, 53 - CAST(floor(log2({a})) AS INTEGER)) AS HUGEINT)"
    n = f"(CAST({a} * pow(2.0, 53 - CAST(floor(log2({a})) AS INTEGER)) AS HUGEINT) * 100)"
    up = (f"CASE WHEN ({n} % {unit}) * 2 > {unit} OR (({n} % {unit}) * 2 = {unit} AND ({n} // {unit}) % 2 = 1)"
          " THEN 1 ELSE 0 END")
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN abs({x}) >= 35184372088832 THEN {x} WHEN abs({x}) < 0.0025 THEN 0.0"
            f" ELSE sign({x}) * CAST({n} // {unit} + {up} AS DOUBLE) / 100 END)")


# ---------------------------------------------------------------- telemetry -------------------

def telemetry_wide(events: DataFrame) -> DataFrame:
    return events.select(
        *[F.when(F.col("event_type") == t, F.col("value")).alias(t) for t in SENSORS],
        F.col("ts").alias("timestamp"),
        F.col("user_id").cast("string").alias("component_id"),
        F.concat(F.lit("line-"), (F.col("user_id") % 3).cast("string")).alias("line_id"),
        F.col("event_id"),
    )


TELEMETRY_SQL = (
    "SELECT " + ", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {t}" for t in SENSORS)
    + ", ts AS timestamp, CAST(user_id AS VARCHAR) AS component_id,"
      " 'line-' || CAST(user_id % 3 AS VARCHAR) AS line_id, event_id FROM events"
)


def telemetry_mapping(ns: str = NS) -> TripleMapping:
    return TripleMapping(
        subject=component_iri("component_id", ns),
        rdf_type=type_iri("Component", ns),
        predicate_objects={predicate_iri(t, ns): F.col(t) for t in SENSORS},
        metadata={"timestamp": F.col("timestamp")},
    )


def triples(events: DataFrame) -> DataFrame:
    return telemetry_mapping().apply(telemetry_wide(events))


TRIPLES_SQL = " UNION ALL ".join(
    [f"SELECT '{NS}/component-' || component_id AS s, 'rdf:type' AS p,"
     f" '{NS}/type/Component' AS o, timestamp FROM telemetry"]
    + [f"SELECT '{NS}/component-' || component_id, '{predicate_iri(t)}',"
       f" CAST({t} AS VARCHAR), timestamp FROM telemetry WHERE {t} IS NOT NULL" for t in SENSORS]
)

CTES = {
    "telemetry": TELEMETRY_SQL,
    "triples": TRIPLES_SQL,
}
DEPENDS = {"telemetry": [], "triples": ["telemetry"]}


def with_ctes(body: str, *names: str, extra: str | None = None, recursive: bool = False) -> str:
    """Prefix ``body`` with the named adapter CTEs and everything they depend on; ``extra`` is
    appended as further CTE text (``recursive`` marks the list WITH RECURSIVE)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + ([extra.strip()] if extra else [])
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


def register_cte(name: str, sql: str, depends: list[str] | None = None) -> None:
    CTES[name] = sql
    DEPENDS[name] = depends or []


# ---------------------------------------------------------------- tag events ------------------

SOURCE_SYSTEM = "gateway-1"


def tag_payload_lines(events: DataFrame) -> DataFrame:
    """One JSON payload line per event: click events come as a one-element array, error events
    above 340 are truncated (corrupt) lines, values are numbers, strings, booleans, null or
    arrays depending on the event type, quality is missing below 5."""
    et, v, uid = F.col("event_type"), F.col("value"), F.col("user_id")
    site = F.concat(F.lit("Site/L"), (uid % 3).cast("string"))
    u = F.concat(F.lit("/U"), uid.cast("string"))
    tag_path = (F.when(et == "error", F.concat(site, F.lit("/error")))
                .when(et == "click", F.concat(F.lit("[]"), site, u, F.lit("/click")))
                .otherwise(F.concat(F.lit("["), et, F.lit("]"), site, u, F.lit("/"), et)))
    vt = v.cast("string")
    value_json = (F.when(et == "view", F.concat(F.lit('"v'), vt, F.lit('"')))
                  .when(et == "purchase", F.when(v > 100, F.lit("true")).otherwise(F.lit("false")))
                  .when(et == "error", F.when(v > 300, F.lit("null"))
                        .when(v > 200, F.concat(F.lit("["), vt, F.lit("]"))).otherwise(vt))
                  .otherwise(vt))
    quality = F.when(v >= 300, F.lit("Bad")).when(v < 5, F.lit(None)).otherwise(F.lit("Good"))
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    obj = F.concat(F.lit('{"tagPath":"'), tag_path, F.lit('","value":'), value_json,
                   F.lit(',"quality":'),
                   F.coalesce(F.concat(F.lit('"'), quality, F.lit('"')), F.lit("null")),
                   F.lit(',"timestamp":'), ms.cast("string"), F.lit("}"))
    line = (F.when((et == "error") & (v > 340), F.concat(F.lit('{"tagPath":"'), tag_path,
                                                         F.lit('",')))
            .when(et == "click", F.concat(F.lit("["), obj, F.lit("]"))).otherwise(obj))
    return events.select("event_id", line.alias("line"))


def ot_events_from(events: DataFrame) -> DataFrame:
    """Payload lines → parsed → defaults → 14-column OT events, ids taken from the source."""
    from otgraph.sources.events import (map_ot_event, parse_tag_payloads, payload_defaults,
                                        split_corrupt)
    good, _dead = split_corrupt(tag_payload_lines(events))
    parsed = parse_tag_payloads(good, keep=("event_id",), parsed="_v")
    d = payload_defaults(parsed, now=F.to_timestamp(F.lit(NOW)), source="http")
    return map_ot_event(d, SOURCE_SYSTEM, include_quality=True, event_id=F.col("event_id"),
                        ingest_ts=F.col("event_ts") + F.expr("INTERVAL 1 SECOND"))


def tag_dimensions(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signal mapping, asset registry) derived from the tags seen in the events."""
    et, uid = F.col("event_type"), F.col("user_id")
    site = F.concat(F.lit("Site/L"), (uid % 3).cast("string"))
    tag_path = (F.when(et == "error", F.concat(site, F.lit("/error")))
                .otherwise(F.concat(F.lit("["), et, F.lit("]"), site, F.lit("/U"),
                                    uid.cast("string"), F.lit("/"), et)))
    asset = F.when(et == "error", F.concat(F.lit("line-"), (uid % 3).cast("string"))) \
        .otherwise(F.concat(F.lit("asset-"), uid.cast("string")))
    base = events.filter(et != "click").select(
        tag_path.alias("tag_path"), asset.alias("asset_id"), et.alias("signal_name"),
        F.when(et == "purchase", "USD").otherwise("count").alias("unit"),
        F.when(et == "signup", 2.0).when(et == "error", 0.5).cast("double").alias("scale"),
        F.when(et == "signup", None).when(et == "error", 1.0).otherwise(2.0).cast("double")
        .alias("offset"),
        (~((et == "error") & (uid % 3 == 0))).alias("active"),
        site.alias("site"),
    ).distinct()
    extra = base.filter(F.col("signal_name") == "purchase").select(
        "tag_path", "asset_id", F.lit("purchase_flag").alias("signal_name"),
        F.lit("flag").alias("unit"), F.lit(None).cast("double").alias("scale"),
        F.lit(None).cast("double").alias("offset"), F.lit(True).alias("active"), "site")
    mapping = base.unionByName(extra)
    registry = base.select(
        "asset_id", F.when(F.col("signal_name") == "error", "line").otherwise("user")
        .alias("asset_type"), "site",
        F.concat(F.lit("Asset "), F.col("asset_id")).alias("display_name"),
        F.lit(True).alias("active")).distinct()
    return mapping.drop("site"), registry


_SITE = "'Site/L' || CAST(user_id % 3 AS VARCHAR)"
_U = "'/U' || CAST(user_id AS VARCHAR)"
_VT = "CAST(value AS VARCHAR)"
register_cte("payload", f"""
SELECT event_id, event_type, user_id, value,
  CASE WHEN event_type = 'error' THEN {_SITE} || '/error'
       WHEN event_type = 'click' THEN '[]' || {_SITE} || {_U} || '/click'
       ELSE '[' || event_type || ']' || {_SITE} || {_U} || '/' || event_type END AS tag_path,
  CASE WHEN event_type = 'view' THEN '"v' || {_VT} || '"'
       WHEN event_type = 'purchase' THEN CASE WHEN value > 100 THEN 'true' ELSE 'false' END
       WHEN event_type = 'error' THEN CASE WHEN value > 300 THEN 'null'
            WHEN value > 200 THEN '[' || {_VT} || ']' ELSE {_VT} END
       ELSE {_VT} END AS value_json,
  CASE WHEN value >= 300 THEN 'Bad' WHEN value < 5 THEN NULL ELSE 'Good' END AS quality,
  epoch_us(ts) // 1000 AS ms,
  (event_type = 'error' AND value > 340) AS corrupt
FROM events""")

register_cte("ot_events", f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, make_timestamp(ms * 1000) AS event_time, tag_path,
  CASE WHEN regexp_extract(tag_path, '^\\[([^\\]]+)\\]', 1) = '' THEN 'default'
       ELSE regexp_extract(tag_path, '^\\[([^\\]]+)\\]', 1) END AS tag_provider,
  CASE WHEN json_type(value_json::JSON) IN ('UBIGINT', 'BIGINT', 'DOUBLE')
       THEN CAST(value_json AS DOUBLE) END AS numeric_value,
  CASE WHEN json_type(value_json::JSON) = 'VARCHAR' THEN value_json::JSON ->> '$' END AS string_value,
  CASE WHEN json_type(value_json::JSON) = 'BOOLEAN' THEN CAST(value_json AS BOOLEAN) END AS boolean_value,
  coalesce(quality, 'GOOD') AS quality,
  CASE WHEN contains(lower(coalesce(quality, 'GOOD')), 'good') THEN 192 ELSE 0 END AS quality_code,
  '{SOURCE_SYSTEM}' AS source_system,
  ms * 1000 + 1000000 AS ingestion_timestamp,
  CASE WHEN json_type(value_json::JSON) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'DOUBLE'
       WHEN json_type(value_json::JSON) = 'VARCHAR' THEN 'STRING'
       WHEN json_type(value_json::JSON) = 'BOOLEAN' THEN 'BOOLEAN' ELSE 'UNKNOWN' END AS data_type,
  '' AS alarm_state, 0 AS alarm_priority
FROM payload WHERE NOT corrupt""", ["payload"])

_MAP_TAG = (f"CASE WHEN event_type = 'error' THEN {_SITE} || '/error' ELSE '[' || event_type || ']'"
            f" || {_SITE} || {_U} || '/' || event_type END")
register_cte("mapping_base", f"""
SELECT DISTINCT {_MAP_TAG} AS tag_path,
  CASE WHEN event_type = 'error' THEN 'line-' || CAST(user_id % 3 AS VARCHAR)
       ELSE 'asset-' || CAST(user_id AS VARCHAR) END AS asset_id,
  event_type AS signal_name,
  CASE WHEN event_type = 'purchase' THEN 'USD' ELSE 'count' END AS unit,
  CAST(CASE WHEN event_type = 'signup' THEN 2.0 WHEN event_type = 'error' THEN 0.5 END AS DOUBLE) AS scale,
  CAST(CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN 1.0 ELSE 2.0 END AS DOUBLE) AS "offset",
  NOT (event_type = 'error' AND user_id % 3 = 0) AS active,
  {_SITE} AS site
FROM events WHERE event_type <> 'click'""")
register_cte("signal_mapping", """
SELECT tag_path, asset_id, signal_name, unit, scale, "offset", active FROM mapping_base
UNION ALL
SELECT tag_path, asset_id, 'purchase_flag', 'flag', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), true
FROM mapping_base WHERE signal_name = 'purchase'""", ["mapping_base"])
register_cte("asset_registry", """
SELECT DISTINCT asset_id, CASE WHEN signal_name = 'error' THEN 'line' ELSE 'user' END AS asset_type,
  site, 'Asset ' || asset_id AS display_name, true AS active FROM mapping_base""", ["mapping_base"])
register_cte("normalized", """
SELECT b.event_time, b.ingestion_timestamp, b.source_system, m.asset_id, m.signal_name, m.unit,
  CASE WHEN b.numeric_value IS NOT NULL THEN b.numeric_value * coalesce(m.scale, 1.0) + coalesce(m."offset", 0.0)
       WHEN b.boolean_value IS NOT NULL THEN CAST(b.boolean_value AS DOUBLE) END AS value_numeric,
  b.string_value, b.quality, b.quality_code, b.tag_path
FROM ot_events b LEFT JOIN signal_mapping m ON b.tag_path = m.tag_path AND m.active = true""",
             ["ot_events", "signal_mapping"])


def fold_sql(source: str, threshold: float) -> str:
    """Recursive-CTE oracle of the change filter over ``source`` (an OT-event CTE)."""
    def changed(e: str, f: str) -> str:
        return (f"(CASE WHEN {e}.kind = 'NULL' AND {f}.lk = 'NULL' THEN false "
                f"WHEN {e}.kind = 'NULL' OR {f}.lk = 'NULL' THEN true "
                f"WHEN {e}.kind = 'NUMBER' AND {f}.lk = 'NUMBER' THEN (NOT isnan({e}.num) AND "
                f"NOT isnan({f}.ln) AND abs({e}.num - {f}.ln) > {threshold}) "
                f"WHEN {e}.kind = 'NUMBER' OR {f}.lk = 'NUMBER' THEN true "
                f"ELSE {e}.key <> {f}.lkey END)")
    seed = "(SELECT 'NULL' AS lk, CAST(NULL AS DOUBLE) AS ln, CAST(NULL AS VARCHAR) AS lkey)"
    ch0, ch = changed("e", "z"), changed("e", "f")
    return f"""
fev AS (SELECT *, row_number() OVER (PARTITION BY tag_path ORDER BY event_time, event_id) AS rn,
  CASE data_type WHEN 'DOUBLE' THEN 'NUMBER' WHEN 'STRING' THEN 'STRING'
       WHEN 'BOOLEAN' THEN 'BOOLEAN' ELSE 'NULL' END AS kind,
  numeric_value AS num,
  CASE WHEN data_type = 'STRING' THEN 'STRING:' || string_value
       WHEN data_type = 'BOOLEAN' THEN 'BOOLEAN:' || CAST(boolean_value AS VARCHAR) END AS key
  FROM {source}),
fold AS (
  SELECT e.tag_path, e.rn, {ch0} AS keep,
    CASE WHEN {ch0} THEN e.kind ELSE z.lk END AS lk,
    CASE WHEN {ch0} THEN e.num ELSE z.ln END AS ln,
    CASE WHEN {ch0} THEN e.key ELSE z.lkey END AS lkey
  FROM fev e, {seed} z WHERE e.rn = 1
  UNION ALL
  SELECT e.tag_path, e.rn, {ch},
    CASE WHEN {ch} THEN e.kind ELSE f.lk END,
    CASE WHEN {ch} THEN e.num ELSE f.ln END,
    CASE WHEN {ch} THEN e.key ELSE f.lkey END
  FROM fold f JOIN fev e ON e.tag_path = f.tag_path AND e.rn = f.rn + 1)"""


# ---------------------------------------------------------------- plant graph -----------------

from otgraph.functions.iri import (DEPENDS_ON, HAS_STATE, PART_OF, PROPAGATES,  # noqa: E402
                                   RDF_TYPE, RDFS_COMMENT, RDFS_LABEL, RDFS_NS, SUB_PROPERTY_OF)

EX = NS + "/schema/"
LOCATED_IN = EX + "locatedIn"
SHIPPED_FROM = EX + "shippedFrom"
PLACED_BY = EX + "placedBy"
BALANCE = EX + "balance"

# The schema triples of the plant graph.
SCHEMA_TRIPLES = [
    (LOCATED_IN, SUB_PROPERTY_OF, PART_OF),
    (SHIPPED_FROM, SUB_PROPERTY_OF, LOCATED_IN),
    (PLACED_BY, SUB_PROPERTY_OF, DEPENDS_ON),
    (LOCATED_IN, RDF_TYPE, RDFS_NS + "Property"),
    (SHIPPED_FROM, RDF_TYPE, RDFS_NS + "Property"),
    (PLACED_BY, RDF_TYPE, RDFS_NS + "Property"),
    (NS + "/type/Region", RDF_TYPE, RDFS_NS + "Class"),
    (NS + "/type/Nation", RDF_TYPE, RDFS_NS + "Class"),
    (NS + "/type/Customer", RDF_TYPE, RDFS_NS + "Class"),
    (NS + "/type/Supplier", RDF_TYPE, RDFS_NS + "Class"),
    (NS + "/type/Order", RDF_TYPE, RDFS_NS + "Class"),
    (NS + "/type/Region", RDFS_LABEL, "Region"),
]


def _iri(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{NS}/{kind}-"), F.col(key).cast("string"))


def plant_graph(spark: SparkSession, sf: str) -> DataFrame:
    """(s, p, o) plant graph from the TPC-H tables, built with triple mappings."""
    maps = [
        ("region", TripleMapping(_iri("region", "r_regionkey"), {RDFS_LABEL: F.col("r_name")},
                                 type_iri("Region"))),
        ("nation", TripleMapping(_iri("nation", "n_nationkey"), {
            RDFS_LABEL: F.col("n_name"), PART_OF: _iri("region", "n_regionkey"),
            PROPAGATES: _iri("region", "n_regionkey")}, type_iri("Nation"))),
        ("customer", TripleMapping(_iri("customer", "c_custkey"), {
            RDFS_LABEL: F.col("c_name"), LOCATED_IN: _iri("nation", "c_nationkey"),
            PROPAGATES: _iri("nation", "c_nationkey"),
            HAS_STATE: F.when(F.col("c_acctbal") < 0, F.lit(f"{NS}/status/degraded")),
            BALANCE: F.col("c_acctbal"), RDFS_COMMENT: F.col("c_mktsegment")},
            type_iri("Customer"))),
        ("supplier", TripleMapping(_iri("supplier", "s_suppkey"), {
            RDFS_LABEL: F.col("s_name"), SHIPPED_FROM: _iri("nation", "s_nationkey")},
            type_iri("Supplier"))),
        ("orders", TripleMapping(_iri("order", "o_orderkey"), {
            PLACED_BY: _iri("customer", "o_custkey"), PROPAGATES: _iri("customer", "o_custkey")},
            type_iri("Order"))),
    ]
    out = spark.createDataFrame(SCHEMA_TRIPLES, "s string, p string, o string")
    for name, m in maps:
        out = out.unionByName(m.apply(table(spark, sf, name)))
    return out


def _sql_lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _sql_map(tab: str, subj: str, typ: str, pos: list[tuple[str, str]]) -> list[str]:
    parts = [f"SELECT {subj} AS s, 'rdf:type' AS p, '{NS}/type/{typ}' AS o FROM {tab}"]
    for p, o in pos:
        parts.append(f"SELECT {subj}, {_sql_lit(p)}, CAST({o} AS VARCHAR) FROM {tab} "
                     f"WHERE {o} IS NOT NULL")
    return parts


def _sql_iri(kind: str, key: str) -> str:
    return f"'{NS}/{kind}-' || CAST({key} AS VARCHAR)"


register_cte("plant_graph", " UNION ALL ".join(
    [f"SELECT * FROM (VALUES " + ", ".join(
        f"({_sql_lit(s)}, {_sql_lit(p)}, {_sql_lit(o)})" for s, p, o in SCHEMA_TRIPLES)
     + ") v(s, p, o)"]
    + _sql_map("region", _sql_iri("region", "r_regionkey"), "Region", [(RDFS_LABEL, "r_name")])
    + _sql_map("nation", _sql_iri("nation", "n_nationkey"), "Nation", [
        (RDFS_LABEL, "n_name"), (PART_OF, _sql_iri("region", "n_regionkey")),
        (PROPAGATES, _sql_iri("region", "n_regionkey"))])
    + _sql_map("customer", _sql_iri("customer", "c_custkey"), "Customer", [
        (RDFS_LABEL, "c_name"), (LOCATED_IN, _sql_iri("nation", "c_nationkey")),
        (PROPAGATES, _sql_iri("nation", "c_nationkey")),
        (HAS_STATE, f"CASE WHEN c_acctbal < 0 THEN '{NS}/status/degraded' END"),
        (BALANCE, "c_acctbal"), (RDFS_COMMENT, "c_mktsegment")])
    + _sql_map("supplier", _sql_iri("supplier", "s_suppkey"), "Supplier", [
        (RDFS_LABEL, "s_name"), (SHIPPED_FROM, _sql_iri("nation", "s_nationkey"))])
    + _sql_map("orders", _sql_iri("order", "o_orderkey"), "Order", [
        (PLACED_BY, _sql_iri("customer", "o_custkey")),
        (PROPAGATES, _sql_iri("customer", "o_custkey"))])
))
