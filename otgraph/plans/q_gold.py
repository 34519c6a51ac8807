"""Registered queries for the silver/gold time-series KPIs and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from otgraph.functions import formulas as P
from otgraph.operators import gold as G
from otgraph.operators import kpis as K
from otgraph.plans.adapters import NOW, register_cte, table, with_ctes
from otgraph.plans.catalog import register


def readings(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", F.concat(F.lit("asset-"), F.col("user_id").cast("string")).alias("asset_id"),
        F.concat(F.lit("Site/L"), (F.col("user_id") % 3).cast("string")).alias("site"),
        F.concat(F.lit("pad-"), (F.col("user_id") % 7).cast("string")).alias("pad"),
        F.concat(F.lit("line-"), (F.col("user_id") % 3).cast("string")).alias("line_id"),
        F.col("event_type").alias("signal"), "ts", "value", "props")


register_cte("readings", """
SELECT event_id, 'asset-' || CAST(user_id AS VARCHAR) AS asset_id,
  'Site/L' || CAST(user_id % 3 AS VARCHAR) AS site, 'pad-' || CAST(user_id % 7 AS VARCHAR) AS pad,
  'line-' || CAST(user_id % 3 AS VARCHAR) AS line_id, event_type AS signal, ts, value, props
FROM events""")

_SEC = "(epoch_us({a}) - epoch_us({b})) / 1e6"


# ------------------------------------------------------------------ as-of, forecast -----------

def _purchase_view(spark, sf):
    r = readings(spark, sf)
    left = r.filter(F.col("signal") == "purchase").select(
        "event_id", "asset_id", "ts", F.col("value").alias("purchase_value"))
    right = r.filter(F.col("signal") == "view").select(
        "asset_id", "ts", F.col("value").alias("view_value"))
    return left, right


_ASOF_BASE = ("FROM (SELECT event_id, asset_id, ts, value AS purchase_value FROM readings"
              " WHERE signal = 'purchase') l ASOF LEFT JOIN (SELECT asset_id, ts, value AS view_value"
              " FROM readings WHERE signal = 'view') r ON l.asset_id = r.asset_id AND l.ts >= r.ts")


@register("asof_join", with_ctes(
    f"SELECT l.event_id, l.asset_id, l.ts, l.purchase_value, r.view_value, r.ts AS asof_ts {_ASOF_BASE}",
    "readings"))
def q_asof(spark, sf):
    left, right = _purchase_view(spark, sf)
    return G.asof_join(left, right, ["asset_id"], "ts", ["view_value"])


@register("asof_join_tolerance", with_ctes(
    "SELECT l.event_id, l.asset_id, l.ts, l.purchase_value,"
    " CASE WHEN r.ts >= l.ts - INTERVAL 1 DAY THEN r.view_value END AS view_value,"
    f" CASE WHEN r.ts >= l.ts - INTERVAL 1 DAY THEN r.ts END AS asof_ts {_ASOF_BASE}", "readings"))
def q_asof_tol(spark, sf):
    left, right = _purchase_view(spark, sf)
    return G.asof_join(left, right, ["asset_id"], "ts", ["view_value"], tolerance="1 day")


register_cte("fva", """
SELECT f.asset_id, f.as_of, f.ts AS target_time, f.forecast, a.actual, f.forecast - a.actual AS error,
  abs(f.forecast - a.actual) / abs(nullif(a.actual, 0.0)) * 100.0 AS abs_pct_error, f.confidence
FROM (SELECT asset_id, ts AS as_of, value AS forecast, least(99.0, 40.0 + value / 10) AS confidence,
        ts + INTERVAL 1 HOUR AS ts FROM readings WHERE signal = 'view') f
ASOF LEFT JOIN (SELECT asset_id, ts, value AS actual FROM readings WHERE signal = 'purchase') a
  ON f.asset_id = a.asset_id AND f.ts >= a.ts""", ["readings"])


def _fva(spark, sf):
    r = readings(spark, sf)
    fc = r.filter(F.col("signal") == "view").select(
        "asset_id", F.col("ts").alias("as_of"), F.col("value").alias("forecast"),
        F.least(F.lit(99.0), F.lit(40.0) + F.col("value") / 10).alias("confidence"))
    act = r.filter(F.col("signal") == "purchase").select("asset_id", "ts",
                                                         F.col("value").alias("actual"))
    return G.forecast_vs_actual(fc, act, ["asset_id"], "1 hour")


@register("forecast_vs_actual", with_ctes("SELECT * FROM fva", "fva"))
def q_fva(spark, sf):
    return _fva(spark, sf)


@register("forecast_accuracy", with_ctes(
    "SELECT time_bucket(INTERVAL 1 HOUR, target_time) AS bucket_start, avg(abs(error)) AS mae,"
    " avg(abs_pct_error) AS mape, avg(error) AS bias, avg(confidence) AS mean_confidence,"
    " count(*) AS n FROM fva WHERE actual IS NOT NULL GROUP BY 1", "fva"), rounded=('mae', 'mape', 'bias', 'mean_confidence'))
def q_fa(spark, sf):
    return G.forecast_accuracy(_fva(spark, sf))


# ------------------------------------------------------------------ integrals -----------------

_LAG = "lag({c}) OVER (PARTITION BY asset_id ORDER BY ts, event_id)"


@register("energy_kwh", with_ctes(
    "SELECT asset_id, day, energy_kwh, energy_kwh / 1000.0 AS energy_mwh,"
    " sum(energy_kwh) OVER (PARTITION BY asset_id ORDER BY day ROWS UNBOUNDED PRECEDING) / 1000.0"
    " AS lifetime_mwh FROM (SELECT asset_id, CAST(ts AS DATE) AS day,"
    f" sum(coalesce(value * {_SEC.format(a='ts', b='pts')} / 3600.0, 0.0)) AS energy_kwh"
    f" FROM (SELECT *, {_LAG.format(c='ts')} AS pts FROM readings) GROUP BY 1, 2)", "readings"), rounded=('energy_kwh', 'energy_mwh', 'lifetime_mwh'))
def q_energy(spark, sf):
    return G.energy_kwh(readings(spark, sf), ["asset_id"], "ts", "value", tie=["event_id"])


@register("curtailed_kwh", with_ctes(
    "SELECT asset_id, CAST(ts AS DATE) AS day, coalesce(sum(CASE WHEN c < 1.0 THEN"
    f" value * c / (1.0 - c) * {_SEC.format(a='ts', b='pts')} / 3600.0 END), 0.0) AS curtailed_kwh"
    " FROM (SELECT *, CASE WHEN signal = 'click' THEN 0.25 ELSE 0.0 END AS c,"
    f" {_LAG.format(c='ts')} AS pts FROM readings) GROUP BY 1, 2", "readings"), rounded=('curtailed_kwh',))
def q_curtailed(spark, sf):
    r = readings(spark, sf).withColumn(
        "c", F.when(F.col("signal") == "click", 0.25).otherwise(0.0))
    return G.curtailed_kwh(r, ["asset_id"], "ts", "value", "c", tie=["event_id"])


@register("bess_metrics", with_ctes(
    "SELECT asset_id, sum(greatest(0.0, -n) * h) AS charge_kwh, sum(greatest(0.0, n) * h) AS"
    " discharge_kwh, sum(abs(n) * h / 1000.0) AS throughput_mwh,"
    " sum(abs(n) * h / 1000.0) / 2.0 AS cycles, 50.0 - sum(n * h) / 1000.0 * 100.0 AS soc_unclamped"
    f" FROM (SELECT asset_id, value - 150.0 AS n, coalesce({_SEC.format(a='ts', b='pts')} / 3600.0,"
    f" 0.0) AS h FROM (SELECT *, {_LAG.format(c='ts')} AS pts FROM readings)) GROUP BY 1",
    "readings"), rounded=('charge_kwh', 'discharge_kwh', 'throughput_mwh', 'cycles', 'soc_unclamped'))
def q_bess(spark, sf):
    r = readings(spark, sf).withColumn("net", F.col("value") - 150.0)
    return G.bess_metrics(r, ["asset_id"], "ts", "net", 1000.0, tie=["event_id"])


# ------------------------------------------------------------------ sequences -----------------

def _counters(spark, sf):
    w = Window.partitionBy("asset_id", F.to_date("ts")).orderBy("ts", "event_id") \
        .rowsBetween(Window.unboundedPreceding, 0)
    return readings(spark, sf).withColumn("counter", F.sum("value").over(w))


@register("counter_delta", with_ctes(
    "SELECT event_id, asset_id, ts, counter, CASE WHEN pc IS NULL THEN 0.0 WHEN counter < pc"
    " THEN counter ELSE counter - pc END AS delta FROM (SELECT *, lag(counter) OVER"
    " (PARTITION BY asset_id ORDER BY ts, event_id) AS pc FROM (SELECT *, sum(value) OVER"
    " (PARTITION BY asset_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
    " AS counter FROM readings))", "readings"), rounded=('counter', 'delta'))
def q_counter_delta(spark, sf):
    c = G.counter_delta(_counters(spark, sf), ["asset_id"], "ts", "counter", tie=["event_id"])
    return c.select("event_id", "asset_id", "ts", "counter", "delta")


register_cte("episodes", f"""
SELECT e.asset_id, e.start_ts, x.end_ts, {_SEC.format(a='x.end_ts', b='e.start_ts')} AS duration_s,
  e.readings, e.reason
FROM (SELECT asset_id, ep, min(ts) AS start_ts, count(*) AS readings,
        arg_min(props, (ts, event_id)) AS reason FROM y WHERE f GROUP BY 1, 2) e
LEFT JOIN (SELECT asset_id, ep, ts AS end_ts FROM y WHERE NOT f AND pf) x
  ON x.asset_id = e.asset_id AND x.ep = e.ep""", ["ep_y"])
register_cte("ep_x", "SELECT *, signal = 'error' AS f, coalesce(lag(signal = 'error') OVER"
             " (PARTITION BY asset_id ORDER BY ts, event_id), false) AS pf FROM readings",
             ["readings"])
register_cte("y", "SELECT *, sum(CASE WHEN f AND NOT pf THEN 1 ELSE 0 END) OVER (PARTITION BY"
             " asset_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ep FROM ep_x", ["ep_x"])
register_cte("ep_y", "SELECT 1", ["y"])


def _episodes(spark, sf):
    r = readings(spark, sf).withColumn("flag", F.col("signal") == "error")
    return G.flag_intervals(r, ["asset_id"], "ts", "flag", reason="props", tie=["event_id"])


@register("flag_intervals", with_ctes("SELECT * FROM episodes", "episodes"))
def q_flag_intervals(spark, sf):
    return _episodes(spark, sf)


@register("events_in_intervals", with_ctes(
    "SELECT r.event_id, r.asset_id, r.ts, e.start_ts FROM readings r JOIN episodes e"
    " ON r.asset_id = e.asset_id AND r.ts BETWEEN e.start_ts AND coalesce(e.end_ts, e.start_ts)",
    "readings", "episodes"))
def q_events_in_intervals(spark, sf):
    ev = readings(spark, sf).select("event_id", "asset_id", "ts")
    iv = _episodes(spark, sf).select("asset_id", "start_ts", "end_ts")
    return G.events_in_intervals(ev, iv, ["asset_id"]).select("event_id", "asset_id", "ts",
                                                               "start_ts")


register_cte("alarm_windows", """
SELECT event_id AS window_id, asset_id, ts AS start_ts, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ts + INTERVAL 3650 DAYS
  ELSE ts + INTERVAL 1 SECOND * CAST(floor(value * 1000) AS BIGINT) END AS end_ts
FROM readings WHERE signal = 'error' AND value > 100""", ["readings"])


@register("events_in_windows", with_ctes(
    "SELECT r.event_id, r.asset_id, r.ts, w.window_id FROM readings r JOIN alarm_windows w"
    " ON r.asset_id = w.asset_id AND r.ts BETWEEN w.start_ts AND coalesce(w.end_ts, w.start_ts)", "readings", "alarm_windows"))
def q_events_in_windows(spark, sf):
    """Overlapping windows from minutes to ten years, some without an end."""
    r = readings(spark, sf)
    end = (F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, F.col("ts") + F.expr("INTERVAL 3650 DAYS"))
           .otherwise(F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor(F.col("value") * 1000) * 1_000_000)))
    windows = r.where("signal = 'error' and value > 100").select(F.col("event_id").alias("window_id"), "asset_id", F.col("ts").alias("start_ts"), end.alias("end_ts"))
    return G.events_in_intervals(r.select("event_id", "asset_id", "ts"), windows, ["asset_id"], disjoint=False) \
        .select("event_id", "asset_id", "ts", "window_id")


@register("tracking_error", with_ctes(
    "SELECT event_id, asset_id, ts, value - t AS error, avg(value - t) OVER (PARTITION BY asset_id"
    " ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS ma_error"
    " FROM (SELECT *, CASE WHEN signal = 'purchase' THEN 200.0 ELSE 100.0 END AS t FROM readings)",
    "readings"), rounded=('ma_error',))
def q_tracking(spark, sf):
    r = readings(spark, sf).withColumn(
        "t", F.when(F.col("signal") == "purchase", 200.0).otherwise(100.0))
    return G.tracking_error(r, ["asset_id"], "ts", "value", "t", 3600) \
        .select("event_id", "asset_id", "ts", "error", "ma_error")


@register("first_change", with_ctes(
    "SELECT e.asset_id, e.event_id, e.ts AS event_ts, arg_min(c.signal, (c.ts, c.signal))"
    " AS first_signal, min(c.ts) AS first_change_ts FROM (SELECT * FROM readings WHERE"
    " signal = 'error') e LEFT JOIN (SELECT * FROM readings WHERE signal <> 'error') c"
    " ON c.asset_id = e.asset_id AND c.ts >= e.ts - INTERVAL 1 HOUR AND c.ts < e.ts"
    " GROUP BY 1, 2, 3", "readings"))
def q_first_change(spark, sf):
    r = readings(spark, sf)
    ch = r.filter(F.col("signal") != "error").select("asset_id", "ts", "signal")
    ev = r.filter(F.col("signal") == "error").select("asset_id", "ts", "event_id")
    return G.first_change(ch, ev, ["asset_id"], "ts", "signal", 3600, "event_id")


@register("limit_hits", with_ctes(
    "SELECT asset_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE value <= 5 AND NOT"
    " coalesce(pv <= 5, false)) AS low_hits, count(*) FILTER (WHERE value >= 300 AND NOT"
    f" coalesce(pv >= 300, false)) AS high_hits FROM (SELECT *, {_LAG.format(c='value')} AS pv"
    " FROM readings) GROUP BY 1, 2", "readings"))
def q_limit_hits(spark, sf):
    return K.limit_hits(readings(spark, sf), ["asset_id"], "ts", "value", 5.0, 300.0,
                        tie=["event_id"])


# ------------------------------------------------------------------ KPI views -----------------

_SIGNALS = ["signup", "view", "purchase", "error", "click"]
_KPI_SQL = ("SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, "
            + ", ".join(f"avg(value) FILTER (WHERE signal = '{s}') AS {s}" for s in _SIGNALS)
            + " FROM readings GROUP BY 1, 2")


def _kpis(spark, sf):
    r = readings(spark, sf).withColumnRenamed("signal", "signal_name")
    return G.site_kpis(r, _SIGNALS, "1 hour", ts="ts", value="value")


@register("site_kpis", with_ctes(_KPI_SQL, "readings"), rounded=('signup', 'view', 'purchase', 'error', 'click'))
def q_site_kpis(spark, sf):
    return _kpis(spark, sf)


@register("site_kpis_daily", with_ctes(
    "SELECT site, CAST(bucket_start AS DATE) AS day, "
    + ", ".join(f"avg({s}) AS avg_{s}" for s in _SIGNALS)
    + ", count(*) AS buckets, sum(coalesce(purchase, 0.0) * coalesce(signup, 0.0)) AS cost_proxy"
    f" FROM ({_KPI_SQL}) GROUP BY 1, 2", "readings"), rounded=('avg_signup', 'avg_view', 'avg_purchase', 'avg_error', 'avg_click', 'cost_proxy'),
          digits=9)  # averages of bucket averages end exactly at the 7th-8th place
def q_site_kpis_daily(spark, sf):
    return G.site_kpis_daily(_kpis(spark, sf), _SIGNALS, "purchase", "signup")


@register("availability_pct", with_ctes(
    "SELECT site, CAST(ts AS DATE) AS day, 100.0 * avg(CAST(signal <> 'error' AS DOUBLE))"
    " AS availability_pct FROM readings GROUP BY 1, 2", "readings"), rounded=('availability_pct',))
def q_availability(spark, sf):
    r = readings(spark, sf).withColumn("day", F.to_date("ts")) \
        .withColumn("available", F.col("signal") != "error")
    return K.availability_pct(r, ["site", "day"], "available")


_KINDS = {"wind_kw": "signup", "solar_kw": "view", "bess_kw": "purchase"}


@register("power_totals", with_ctes(
    "SELECT site, " + ", ".join(f"coalesce(sum(value) FILTER (WHERE signal = '{k}'), 0.0) AS {n}"
                                for n, k in _KINDS.items())
    + ", " + " + ".join(f"coalesce(sum(value) FILTER (WHERE signal = '{k}'), 0.0)"
                        for k in _KINDS.values())
    + " AS net_kw FROM readings GROUP BY 1", "readings"), rounded=('wind_kw', 'solar_kw', 'bess_kw', 'net_kw'))
def q_power_totals(spark, sf):
    return K.power_totals(readings(spark, sf), ["site"], "signal", "value", _KINDS)


@register("well_totals", with_ctes(
    "SELECT site, pad, sum(liquid) AS liquid_total, sum(gas) AS gas_total, count(*) AS readings"
    " FROM (SELECT site, pad, CASE WHEN signal IN ('signup', 'view') THEN value ELSE 0.0 END"
    " AS liquid, CASE WHEN signal IN ('purchase', 'click') THEN value ELSE 0.0 END AS gas"
    " FROM readings) GROUP BY ROLLUP (site, pad)", "readings"), rounded=('liquid_total', 'gas_total'))
def q_well_totals(spark, sf):
    r = readings(spark, sf).select(
        "site", "pad",
        F.when(F.col("signal").isin("signup", "view"), F.col("value")).otherwise(0.0).alias("liquid"),
        F.when(F.col("signal").isin("purchase", "click"), F.col("value")).otherwise(0.0).alias("gas"))
    return K.well_totals(r, "site", "pad", "liquid", "gas")


@register("spc", """
SELECT l_partkey, mean, sigma, n, deviation, cpk, cpk < 1.0 OR abs(deviation) > 35.0 AS out_of_control,
  CASE WHEN cpk < 1.0 THEN 'Low Cpk' WHEN abs(deviation) > 35.0 THEN 'Kiln deviation' ELSE '' END AS ooc_reason FROM (
  SELECT *, greatest(0.0, least(least((45.0 - abs(mean - 25.5)) / (3.0 * greatest(0.0005,
    coalesce(sigma, 0.0))), 2.5), 2.5)) AS cpk
  FROM (SELECT l_partkey, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sigma,
        count(*) AS n, avg((l_discount * 1000 - 50) * 10) AS deviation FROM lineitem GROUP BY 1))""",
          rounded=('mean', 'sigma', 'cpk', 'deviation'))
def q_spc(spark, sf):
    return K.spc(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity", 25.5, 45.0,
                 deviation=(F.col("l_discount") * 1000 - 50) * 10)


@register("oee", """
SELECT l_suppkey, a, p, q, greatest(0.0, least(a * p * q / 10000.0, 99.9)) AS oee FROM (
  SELECT l_suppkey, 100.0 * avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS a,
    100.0 * avg(1.0 - l_discount) AS p,
    100.0 * (1.0 - avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)) AS q
  FROM lineitem GROUP BY 1)""", rounded=('a', 'p', 'q', 'oee'))
def q_oee(spark, sf):
    li = table(spark, sf, "lineitem")
    agg = li.groupBy("l_suppkey").agg(
        (100.0 * F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0))).alias("a"),
        (100.0 * F.avg(1.0 - F.col("l_discount"))).alias("p"),
        (100.0 * (1.0 - F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)))).alias("q"))
    return agg.withColumn("oee", K.oee(F.col("a"), F.col("p"), F.col("q")))


@register("scrap_rate", """
SELECT l_partkey, good, reject, CASE WHEN good + reject > 0 THEN 100.0 * reject / (good + reject)
  ELSE 0.0 END AS scrap_rate FROM (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag <> 'R')
  AS good, count(*) FILTER (WHERE l_returnflag = 'R') AS reject FROM lineitem GROUP BY 1)""", rounded=('scrap_rate',))
def q_scrap(spark, sf):
    li = table(spark, sf, "lineitem")
    agg = li.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("good"),
                                      F.count_if(F.col("l_returnflag") == "R").alias("reject"))
    return agg.withColumn("scrap_rate", K.scrap_rate(F.col("good"), F.col("reject")))


@register("outlier_rate", with_ctes(
    "SELECT r.asset_id, count(*) AS readings, count(*) FILTER (WHERE coalesce(abs(r.value - p.base)"
    " > 2.0 * p.sigma, false)) AS outliers, avg(CASE WHEN coalesce(abs(r.value - p.base) > 2.0 *"
    " p.sigma, false) THEN 1.0 ELSE 0.0 END) AS outlier_rate FROM readings r LEFT JOIN"
    " (SELECT line_id, signal, avg(value) AS base, stddev_pop(value) AS sigma FROM readings"
    " GROUP BY 1, 2) p ON p.line_id = r.line_id AND p.signal = r.signal GROUP BY 1", "readings"), rounded=('outlier_rate',))
def q_outlier_rate(spark, sf):
    r = readings(spark, sf)
    prof = r.groupBy("line_id", "signal").agg(F.avg("value").alias("base"),
                                              F.stddev_pop("value").alias("sigma"))
    return K.outlier_rate(r, prof, ["asset_id"], "line_id", "signal", "value", k=2.0)


_PC = ("CASE WHEN v < 3 OR v >= 25 THEN 0.0 WHEN v >= 12 THEN 100.0"
       " ELSE 100.0 * pow((v - 3) / greatest(0.1, 12 - 3), 3) END")


@register("underperformance", with_ctes(
    "SELECT asset_id, avg(e) AS avg_expected_kw, avg(power) AS avg_actual_kw,"
    " avg(CASE WHEN e > 0 AND power IS NOT NULL THEN power / e END) AS performance_ratio,"
    " count(CASE WHEN e > 0 AND power IS NOT NULL THEN power / e END) AS readings FROM ("
    f" SELECT s.asset_id, {_PC} AS e, p.power FROM (SELECT asset_id, ts, value / 20 AS v FROM"
    " readings WHERE signal = 'signup') s ASOF LEFT JOIN (SELECT asset_id, ts, value AS power"
    " FROM readings WHERE signal = 'purchase') p ON s.asset_id = p.asset_id AND s.ts >= p.ts)"
    " GROUP BY 1", "readings"), rounded=('avg_expected_kw', 'avg_actual_kw', 'performance_ratio'))
def q_underperformance(spark, sf):
    r = readings(spark, sf)
    sp = r.filter(F.col("signal") == "signup").select("asset_id", "ts",
                                                      (F.col("value") / 20).alias("v"))
    pw = r.filter(F.col("signal") == "purchase").select("asset_id", "ts",
                                                        F.col("value").alias("power"))
    return K.underperformance(sp, pw, ["asset_id"], "ts", "v", "power", 100.0, 3.0, 12.0, 25.0)


@register("poi_vs_plant", with_ctes(
    "SELECT site, bucket_start, plant_net_kw, export_kw, export_kw - plant_net_kw AS difference_kw"
    " FROM (SELECT *, greatest(0.0, least(plant_net_kw, 1000.0 * (1.0 - 25.0 / 100.0))) AS"
    " export_kw FROM (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start,"
    " sum(value) AS plant_net_kw FROM readings WHERE ts >= TIMESTAMP '" + NOW + "' - INTERVAL 6 HOURS"
    " AND ts < TIMESTAMP '" + NOW + "' AND signal IN ('signup', 'view', 'purchase') GROUP BY 1, 2))",
    "readings"), rounded=('plant_net_kw', 'export_kw', 'difference_kw'))
def q_poi(spark, sf):
    return K.poi_vs_plant(readings(spark, sf), ["site"], "ts", "signal", "value",
                          ["signup", "view", "purchase"], 1000.0, 25.0, NOW, hours=6)


@register("meter_vs_plant", with_ctes(
    "SELECT site, bucket_start, plant_net_kw, m.v AS meter_kw, m.ts AS meter_ts, m.v - plant_net_kw AS difference_kw FROM (SELECT *,"
    " (SELECT max(struct_pack(ts := r.ts, v := r.value * 4)) FROM readings r WHERE r.site = b.site AND r.signal = 'click' AND r.ts <= b.bucket_start"
    " + INTERVAL 1 HOUR AND r.ts >= b.bucket_start + INTERVAL 1 HOUR - INTERVAL 90 MINUTES) AS m"
    " FROM (SELECT site, time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, sum(value) AS plant_net_kw FROM readings"
    f" WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 72 HOURS AND ts < TIMESTAMP '{NOW}' AND signal IN ('signup', 'view', 'purchase') GROUP BY 1, 2) b)",
    "readings"), rounded=('plant_net_kw', 'meter_kw', 'difference_kw'))
def q_meter_vs_plant(spark, sf):
    """Click readings stand in for the grid meter of a site."""
    r = readings(spark, sf)
    meter = r.where("signal = 'click'").select("site", "ts", (F.col("value") * 4).alias("export"))
    return K.meter_vs_plant(r, meter, ["site"], "ts", "signal", "value", ["signup", "view", "purchase"], "export", NOW, hours=72,
                            tolerance="90 MINUTES")


@register("kpi_formulas", with_ctes(
    f"SELECT event_id, {_PC.replace('v', '(value / 20)')} AS power_kw,"
    " ((value * 3) % 360 + 360) % 360 AS wrap_deg,"
    " ((value - 180.0 + 180.0) % 360 + 360) % 360 - 180.0 AS ang_diff_deg,"
    " pow(greatest(0.0, cos(radians(value / 10))), 1.7) AS yaw_derate,"
    " value * tan(acos(0.95)) AS reactive_kvar,"
    " CASE WHEN value <= 0 THEN 0.0 ELSE value * 1000.0 / (sqrt(3.0) * 690.0 * greatest(0.1, 0.97))"
    " END AS current_a, greatest(10.0, least(value, 300.0)) AS clamped,"
    " CASE WHEN signal = 'error' THEN 'FREQ_EVENT' WHEN value > 300 THEN 'VOLT_SAG'"
    " WHEN signal = 'click' THEN 'CONSTRAINT' ELSE '' END AS grid_event,"
    " CASE WHEN value > 300 THEN 'ENERGY_SPIKE' WHEN signal = 'click' THEN 'CONSTRAINT' ELSE ''"
    " END AS energy_event,"
    " CASE WHEN value >= 195 THEN 'CRITICAL' WHEN value >= 185 THEN 'WARNING' ELSE 'ok' END"
    " AS severity,"
    " CASE WHEN NOT (signal <> 'error') THEN 3 WHEN value > 0 THEN 2 ELSE 0 END AS operating_state,"
    " 500.0 * greatest(0.0, least(value * 3 / 1000.0, 1.15)) * greatest(0.8, least(1.0 -"
    " greatest(0.0, value / 10 - 25.0) * 0.004, 1.05)) AS solar_kw,"
    " CASE WHEN abs(value - 150) > 25.0 THEN 'Warp/crack' WHEN value > 120 THEN 'Lamination'"
    " ELSE 'None' END AS top_defect,"
    " CASE WHEN abs(value - 150) > 25.0 THEN 'Warp/crack (sinter profile)' WHEN value / 125 > 1.2 THEN 'Lamination (moisture)'"
    " WHEN signal = 'error' THEN 'Chipping (press handling)' WHEN value / 200 > 0.7 THEN 'Surface finish (tool wear)'"
    " ELSE 'None' END AS press_defect, value / 40 > 4.0 AS smoke_assist"
    " FROM readings", "readings"), rounded=('power_kw', 'wrap_deg', 'ang_diff_deg', 'yaw_derate', 'reactive_kvar', 'current_a', 'solar_kw'))
def q_formulas(spark, sf):
    r = readings(spark, sf)
    v, sig = F.col("value"), F.col("signal")
    return r.select(
        "event_id",
        P.power_curve(v / 20, 100.0, 3.0, 12.0, 25.0).alias("power_kw"),
        P.wrap_deg(v * 3).alias("wrap_deg"),
        P.ang_diff_deg(v, 180.0).alias("ang_diff_deg"),
        P.yaw_derate(v / 10).alias("yaw_derate"),
        P.reactive_kvar(v, 0.95).alias("reactive_kvar"),
        P.current_a(v, 690.0, 0.97).alias("current_a"),
        P.clamp(v, 10.0, 300.0).alias("clamped"),
        P.grid_event_label(sig == "error", v > 300, sig == "click").alias("grid_event"),
        P.energy_event_label(v > 300, sig == "click").alias("energy_event"),
        P.severity(v, 185.0, 195.0).alias("severity"),
        P.operating_state(sig != "error", v).alias("operating_state"),
        P.solar_expected(v * 3, v / 10, 500.0).alias("solar_kw"),
        P.top_defect([(F.abs(v - 150) > 25.0, "Warp/crack"), (v > 120, "Lamination")],
                     "None").alias("top_defect"),
        P.press_defect(v - 150, v / 125, sig == "error", v / 200).alias("press_defect"),
        P.smoke_assist(v / 40).alias("smoke_assist"),
    )


@register("bess_soc_clamped", with_ctes(
    "SELECT asset_id, ts, event_id, soc FROM walk", "readings",
    extra="""r AS (SELECT asset_id, ts, event_id, value - 150.0 AS n,
  coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 / 3600.0, 0.0) AS h,
  row_number() OVER w AS rn FROM readings WINDOW w AS (PARTITION BY asset_id ORDER BY ts, event_id)),
walk AS (SELECT asset_id, ts, event_id, rn, greatest(5.0, least(50.0 - n * h / 1000.0 * 100.0, 95.0)) AS soc
  FROM r WHERE rn = 1
  UNION ALL SELECT r.asset_id, r.ts, r.event_id, r.rn,
    greatest(5.0, least(w.soc - r.n * r.h / 1000.0 * 100.0, 95.0))
  FROM walk w JOIN r ON r.asset_id = w.asset_id AND r.rn = w.rn + 1)""", recursive=True), rounded=('soc',))
def q_soc_clamped(spark, sf):
    r = readings(spark, sf).withColumn("net", F.col("value") - 150.0)
    return G.bess_soc_clamped(r, "asset_id", "ts", "net", 1000.0, tie=["event_id"])
