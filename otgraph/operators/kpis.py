"""Operations KPIs (A13-A22): availability, power totals, well totals, process capability,
OEE, scrap, limit hits, outliers against stage profiles, underperformance, POI vs plant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otgraph.functions.formulas import clamp, ooc_reason, out_of_control, poi_flows, power_curve
from otgraph.operators.gold import asof_join
from otgraph.operators.series import with_prev


def availability_pct(df: DataFrame, keys: Sequence[str], available: str) -> DataFrame:
    """100 · available / all units."""
    return df.groupBy(*keys).agg(
        (100.0 * F.avg(F.col(available).cast("double"))).alias("availability_pct"))


def power_totals(df: DataFrame, keys: Sequence[str], kind: str, power: str,
                 kinds: dict[str, str]) -> DataFrame:
    """Sum of power per kind (output column → kind value) and the net over all kinds."""
    aggs = [F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(power))), F.lit(0.0)).alias(name)
            for name, k in kinds.items()]
    net = sum((F.col(name) for name in kinds), F.lit(0.0))
    return df.groupBy(*keys).agg(*aggs).withColumn("net_kw", net)


def well_totals(df: DataFrame, site: str, pad: str, liquid: str, gas: str) -> DataFrame:
    """Liquid and gas totals per pad, per site (pad NULL) and overall (both NULL)."""
    return df.rollup(site, pad).agg(F.sum(liquid).alias("liquid_total"),
                                    F.sum(gas).alias("gas_total"),
                                    F.count(F.lit(1)).alias("readings"))


def spc(df: DataFrame, keys: Sequence[str], value: str, target: float, tol: float,
        deviation: Column | None = None) -> DataFrame:
    """mean, sigma (sample), Cpk = clamp(min((tol − |mean − target|)/(3·max(0.0005, σ)), 2.5),
    0, 2.5), the mean ``deviation`` of the process (0 if not given), out-of-control (Cpk < 1 or
    |deviation| > 35) and its reason per key (A16)."""
    dev = F.lit(0.0) if deviation is None else deviation
    agg = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sigma"),
                                F.count(F.lit(1)).alias("n"), F.avg(dev).alias("deviation"))
    raw = (F.lit(tol) - F.abs(F.col("mean") - F.lit(target))) / \
        (3.0 * F.greatest(F.lit(0.0005), F.coalesce(F.col("sigma"), F.lit(0.0))))
    cpk = clamp(F.least(raw, F.lit(2.5)), 0.0, 2.5)
    return agg.withColumn("cpk", cpk).withColumns(
        {"out_of_control": out_of_control(F.col("cpk"), F.col("deviation")),
         "ooc_reason": ooc_reason(F.col("cpk"), F.col("deviation"))})


def oee(availability: Column, performance: Column, quality: Column) -> Column:
    """OEE % = A·P·Q / 10000 clamped to [0, 99.9]."""
    return clamp(availability * performance * quality / 10000.0, 0.0, 99.9)


def scrap_rate(good: Column, reject: Column) -> Column:
    """100 · reject / (good + reject), 0 when both are 0."""
    total = good + reject
    return F.when(total > 0, 100.0 * reject / total).otherwise(F.lit(0.0))


def limit_hits(df: DataFrame, keys: Sequence[str], ts: str, value: str, lo: float, hi: float,
               tie: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """How often a signal reached its low / high limit per key and day (A19): rising edges
    of ``v <= lo`` and ``v >= hi``."""
    p = with_prev(df, list(keys), ts, [value], tie=tie, unit=unit)
    v, pv = F.col(value), F.col(f"prev_{value}")
    low = (v <= lo) & ~F.coalesce(pv <= lo, F.lit(False))
    high = (v >= hi) & ~F.coalesce(pv >= hi, F.lit(False))
    return p.groupBy(*keys, F.to_date(F.col(ts)).alias("day")).agg(
        F.count_if(low).alias("low_hits"), F.count_if(high).alias("high_hits"))


def outlier_rate(readings: DataFrame, profiles: DataFrame, keys: Sequence[str],
                 stage: str, sensor: str, value: str, k: float = 3.0) -> DataFrame:
    """Share of readings outside base ± k·sigma of their (stage, sensor) profile.

    ``readings`` is long (stage, sensor, value, keys…); unknown profiles count as inliers."""
    j = readings.join(profiles.select(stage, sensor, "base", "sigma"), [stage, sensor], "left")
    out = F.coalesce(F.abs(F.col(value) - F.col("base")) > k * F.col("sigma"), F.lit(False))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("readings"),
                                F.count_if(out).alias("outliers"),
                                F.avg(out.cast("double")).alias("outlier_rate"))


def underperformance(speed: DataFrame, power: DataFrame, keys: Sequence[str], ts: str,
                     speed_col: str, power_col: str, rated_kw: float, cut_in: float,
                     rated_v: float, cut_out: float) -> DataFrame:
    """Actual power (as of each wind reading) against the power-curve expectation, per key
    (A21): mean ratio actual / expected over readings with expected > 0."""
    j = asof_join(speed, power.select(*keys, ts, power_col), keys, ts, [power_col])
    exp = power_curve(F.col(speed_col), rated_kw, cut_in, rated_v, cut_out)
    j = j.withColumn("expected_kw", exp)
    ratio = F.when((F.col("expected_kw") > 0) & F.col(power_col).isNotNull(),
                   F.col(power_col) / F.col("expected_kw"))
    return j.groupBy(*keys).agg(F.avg("expected_kw").alias("avg_expected_kw"),
                                F.avg(power_col).alias("avg_actual_kw"),
                                F.avg(ratio).alias("performance_ratio"),
                                F.count(ratio).alias("readings"))


def poi_vs_plant(df: DataFrame, keys: Sequence[str], ts: str, kind: str, power: str,
                 kinds: Sequence[str], target_kw: float, curtail_pct: float, now,
                 hours: int = 6, every: str = "1 hour") -> DataFrame:
    """Export at the grid meter (P20 of the plant net) vs the plant net per key and bucket over
    the last ``hours`` before ``now`` (A22)."""
    now_c = F.to_timestamp(F.lit(str(now)))
    recent = df.filter((F.col(ts) >= now_c - F.expr(f"INTERVAL {int(hours)} HOURS"))
                       & (F.col(ts) < now_c) & F.col(kind).isin(list(kinds)))
    agg = recent.groupBy(*keys, F.window(F.col(ts), every).start.alias("bucket_start")) \
        .agg(F.sum(power).alias("plant_net_kw"))
    flows = poi_flows(F.col("plant_net_kw"), target_kw, curtail_pct, F.lit(True))
    return agg.select(*keys, "bucket_start", "plant_net_kw",
                      flows["export_kw"].alias("export_kw"),
                      (flows["export_kw"] - F.col("plant_net_kw")).alias("difference_kw"))


def meter_vs_plant(plant: DataFrame, meter: DataFrame, keys: Sequence[str], ts: str, kind: str, power: str,
                   kinds: Sequence[str], reading: str, now, hours: int = 6, every: str = "1 hour",
                   tolerance: str | None = None) -> DataFrame:
    """The meter's reading against the plant net per key and bucket over the last ``hours`` before ``now`` (A22). The plant
    net sums the ``kinds`` of the bucket; the meter is read as of the bucket's end (J5), not earlier than
    ``tolerance`` before it. Without a reading the difference is NULL."""
    now_c = F.to_timestamp(F.lit(str(now)))
    recent = plant.filter((F.col(ts) >= now_c - F.expr(f"INTERVAL {int(hours)} HOURS")) & (F.col(ts) < now_c) & F.col(kind).isin(list(kinds)))
    net = recent.groupBy(*keys, F.window(F.col(ts), every).alias("_w")).agg(F.sum(power).alias("plant_net_kw"))
    net = net.select(*keys, F.col("_w.start").alias("bucket_start"), F.col("_w.end").alias("bucket_end"), "plant_net_kw")
    at_end = meter.select(*keys, F.col(ts).alias("bucket_end"), F.col(reading).alias("meter_kw"))
    j = asof_join(net, at_end, keys, "bucket_end", ["meter_kw"], tolerance=tolerance, right_ts="meter_ts")
    return j.select(*keys, "bucket_start", "plant_net_kw", "meter_kw", "meter_ts", (F.col("meter_kw") - F.col("plant_net_kw")).alias("difference_kw"))
