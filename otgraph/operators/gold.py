"""Gold layer: as-of and range joins, forecast accuracy, energy integrals, battery metrics,
counter deltas, episodes, tracking error, first mover, curtailment, site KPIs
(J5-J7, W3-W9, A10-A12).

Per-key sequences use :mod:`otgraph.operators.series`, so a hot asset is split by day.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from otgraph.functions.formulas import clamp
from otgraph.operators.series import ffill, seconds_between, with_context, with_prev


# ------------------------------------------------------------------ joins ---------------------

def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str,
              values: Sequence[str], tolerance: str | None = None, unit: str = "day",
              right_ts: str = "asof_ts") -> DataFrame:
    """For each left row, the newest right row of the same key with ``right.ts <= left.ts``
    (J5); ``values`` and the right timestamp (``right_ts``) are added, NULL when there is none
    or it is older than ``tolerance``. Union + forward fill, never a theta join; equal
    timestamps on the right resolve to the greatest values."""
    keys, values = list(keys), list(values)
    lcols = left.columns
    # SQL: a NULL key matches nothing
    right = right.dropna(subset=keys)
    r = right.select(*keys, F.col(ts), F.struct(F.col(ts).alias("t"),
                                                *[F.col(v).alias(v) for v in values]).alias("_rv"),
                     F.lit(0).alias("_side"))
    l = left.withColumn("_side", F.lit(1))
    u = l.unionByName(r, allowMissingColumns=True)
    filled = ffill(u, keys, ts, F.col("_rv"), "_hit", order=["_side", "_rv"], unit=unit)
    out = filled.filter(F.col("_side") == 1)
    ok = F.col("_hit").isNotNull()
    if tolerance:
        ok = ok & (F.col("_hit.t") >= F.col(ts) - F.expr(f"INTERVAL {tolerance}"))
    return out.select(*lcols, *[F.when(ok, F.col("_hit")[v]).alias(v) for v in values],
                      F.when(ok, F.col("_hit.t")).alias(right_ts))


def forecast_vs_actual(forecast: DataFrame, actual: DataFrame, keys: Sequence[str],
                       horizon: str = "1 hour", as_of: str = "as_of", value: str = "forecast",
                       confidence: str = "confidence", actual_ts: str = "ts",
                       actual_value: str = "actual", tolerance: str | None = None) -> DataFrame:
    """Match a forecast made at ``as_of`` with the actual value at ``as_of + horizon`` (J6):
    error = forecast − actual, absolute % error (NULL when actual is 0), confidence carried."""
    keys = list(keys)
    f = forecast.select(*keys, F.col(as_of), F.col(value).alias("forecast"),
                        F.col(confidence).alias("confidence"),
                        (F.col(as_of) + F.expr(f"INTERVAL {horizon}")).alias(actual_ts))
    a = actual.select(*keys, F.col(actual_ts), F.col(actual_value).alias("actual"))
    j = asof_join(f, a, keys, actual_ts, ["actual"], tolerance=tolerance)
    err = F.col("forecast") - F.col("actual")
    return j.select(*keys, F.col(as_of), F.col(actual_ts).alias("target_time"), "forecast",
                    "actual", err.alias("error"),
                    (F.abs(err) / F.abs(F.nullif(F.col("actual"), F.lit(0.0))) * 100.0)
                    .alias("abs_pct_error"), "confidence")


def events_in_intervals(events: DataFrame, intervals: DataFrame, keys: Sequence[str],
                        ts: str = "ts", start: str = "start_ts", end: str = "end_ts",
                        disjoint: bool = True, bucket_seconds: int = 3600,
                        unit: str = "day") -> DataFrame:
    """Events inside ``[start, end]`` of an interval of the same key (J7). Open intervals
    (NULL end) are closed at their start.

    ``disjoint`` (intervals of a key never overlap, e.g. episodes): an as-of lookup — the
    latest interval starting at or before each event, then the end bound — so no event is
    paired with any interval but its own. Otherwise a range join: an interval is cut into dyadic pieces of cells of
    ``bucket_seconds``, at most two of each scale, and an event looks up its cell at every scale that
    occurs, so a ten-year interval is some thirty rows and all joins are on (key, scale, cell). Only events in the
    cells that an interval covers in part are compared with its exact bounds in vain. The join is a merge join: the
    planner does not see how often a row is repeated and would broadcast repeated events by the size of their file.
    """
    keys = list(keys)
    intervals = intervals.dropna(subset=keys)        # SQL: a NULL key matches nothing
    iv_cols = [c for c in intervals.columns if c not in keys]
    end_c = F.coalesce(F.col(end), F.col(start))
    if disjoint:
        iv = intervals.select(*keys, F.col(start).alias(ts),
                              F.struct(*[F.col(c) for c in iv_cols],
                                       end_c.alias("_end")).alias("_iv"))
        ev = events.withColumn("_iv", F.lit(None).cast(iv.schema["_iv"].dataType)) \
            .withColumn("_is_ev", F.lit(True))
        u = ev.unionByName(iv.withColumn("_is_ev", F.lit(False)), allowMissingColumns=True)
        # at equal times the interval row sorts first, so an event at the start is inside
        filled = ffill(u, keys, ts, F.col("_iv"), "_hit", order=["_is_ev"], unit=unit)
        hit = filled.filter(F.col("_is_ev") & F.col("_hit").isNotNull()
                            & (F.col(ts) <= F.col("_hit._end")))
        return hit.select(*events.columns, *[F.col("_hit")[c].alias(c) for c in iv_cols])
    cell = lambda c: F.floor(F.unix_seconds(c.cast("timestamp")) / bucket_seconds)
    iv = intervals.where(F.col(start) <= end_c).withColumn("_piece", F.explode(dyadic_pieces(cell(F.col(start)), cell(end_c) + 1)))
    iv = iv.withColumn("_k", F.col("_piece.k")).withColumn("_c", F.col("_piece.c")).drop("_piece")
    scales = sorted(r["_k"] for r in iv.select("_k").distinct().collect())           # at most 63
    ev = events.withColumn("_k", F.explode(F.array(*[F.lit(k) for k in scales]).cast("array<int>"))) \
        .withColumn("_c", F.call_function("shiftright", cell(F.col(ts)), F.col("_k")))
    j = ev.hint("merge").join(iv.hint("merge"), on=keys + ["_k", "_c"], how="inner")
    return j.filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= end_c)).drop("_k", "_c")


def dyadic_pieces(first: Column, end: Column) -> Column:
    """The cells [first, end) as an array of (k, c): piece c of scale k covers the cells from c * 2^k on, 2^k of them;
    pieces do not overlap and at most two share a scale. At scale k the cells left are those from ceil(first / 2^k) to
    floor(end / 2^k): an odd first and an odd end belong to no piece of the next scale."""
    def at(k: Column) -> Column:
        lo, hi = -F.call_function("shiftright", -first, k), F.call_function("shiftright", end, k)
        left = F.when((lo < hi) & (lo % 2 != 0), F.struct(k.alias("k"), lo.alias("c")))
        right = F.when((lo < hi) & (hi % 2 != 0), F.struct(k.alias("k"), (hi - 1).alias("c")))
        return F.array(left, right)

    scales = F.sequence(F.lit(0), F.ceil(F.log2(end - first)).cast("int") + 1)
    return F.filter(F.flatten(F.transform(scales, at)), lambda x: x.isNotNull())


# ------------------------------------------------------------------ integrals -----------------

def energy_kwh(df: DataFrame, keys: Sequence[str], ts: str, power_kw: str,
               dt_bounds: tuple[float, float] | None = None, tie: Sequence[str] = (),
               unit: str = "day") -> DataFrame:
    """∫ p dt per key and day (W3): each reading contributes ``p·dt/3600`` kWh with dt the
    seconds since the previous reading of the key (optionally clamped, e.g. (0.2, 5));
    ``energy_mwh`` is kWh/1000 and ``lifetime_mwh`` the running total over days."""
    keys = list(keys)
    p = with_prev(df, keys, ts, [power_kw], tie=tie, unit=unit)
    dt = seconds_between(ts, f"prev_{ts}")
    if dt_bounds:
        dt = clamp(dt, *dt_bounds)                     # NULL (first reading) stays NULL
    contrib = F.coalesce(F.col(power_kw) * dt / 3600.0, F.lit(0.0))
    daily = (p.withColumn("_e", contrib)
             .groupBy(*keys, F.to_date(F.col(ts)).alias("day"))
             .agg(F.sum("_e").alias("energy_kwh")))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*keys, "day", "energy_kwh", (F.col("energy_kwh") / 1000.0)
                        .alias("energy_mwh"),
                        (F.sum("energy_kwh").over(w) / 1000.0).alias("lifetime_mwh"))


def curtailed_kwh(df: DataFrame, keys: Sequence[str], ts: str, power_kw: str, curtail: str,
                  tie: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """Energy spilled by curtailment (W9): delivered power is p·(1−c), so the spill is
    ∫ p·c/(1−c) dt over readings with c < 1, per key and day."""
    keys = list(keys)
    p = with_prev(df, keys, ts, [power_kw, curtail], tie=tie, unit=unit)
    dt = seconds_between(ts, f"prev_{ts}")
    c = F.col(curtail)
    spill = F.when(c < 1.0, F.col(power_kw) * c / (1.0 - c) * dt / 3600.0)
    return (p.withColumn("_s", spill)
            .groupBy(*keys, F.to_date(F.col(ts)).alias("day"))
            .agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("curtailed_kwh")))


def bess_metrics(df: DataFrame, keys: Sequence[str], ts: str, net_kw: str, capacity_kwh: float,
                 soc0: float = 50.0, tie: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """Battery totals per key (W4): charge / discharge kWh (net > 0 discharges), throughput
    MWh, cycles = throughput / max(0.001, 2·capacity MWh), and the unclamped SOC walk
    ``soc0 − Σ net·dt/3600 / capacity · 100`` — all exact running sums."""
    keys = list(keys)
    p = with_prev(df, keys, ts, [net_kw], tie=tie, unit=unit)
    h = F.coalesce(seconds_between(ts, f"prev_{ts}") / 3600.0, F.lit(0.0))
    n = F.col(net_kw)
    agg = (p.groupBy(*keys).agg(
        F.sum(F.greatest(F.lit(0.0), -n) * h).alias("charge_kwh"),
        F.sum(F.greatest(F.lit(0.0), n) * h).alias("discharge_kwh"),
        F.sum(F.abs(n) * h / 1000.0).alias("throughput_mwh"),
        F.sum(n * h).alias("_net_kwh")))
    return agg.select(*keys, "charge_kwh", "discharge_kwh", "throughput_mwh",
                      (F.col("throughput_mwh") / max(0.001, capacity_kwh / 1000.0 * 2.0))
                      .alias("cycles"),
                      (F.lit(soc0) - F.col("_net_kwh") / capacity_kwh * 100.0).alias("soc_unclamped"))


def bess_soc_clamped(df: DataFrame, key: str, ts: str, net_kw: str, capacity_kwh: float,
                     soc0: float = 50.0, lo: float = 5.0, hi: float = 95.0,
                     partitions: int | None = None, tie: Sequence[str] = (),
                     unit: str = "day") -> DataFrame:
    """SOC walk clamped to [lo, hi] after every step (W4), output (key, ts, *tie, soc).

    Each step is ``x → clamp(x + d, lo, hi)`` with ``d = −net·hours/capacity·100``, and such
    maps compose into one of the same shape: ``(D, L, H): x → min(max(x + D, L), H)``. So
    (1) every (key, day) composes its steps in a streamed fold, (2) the small day table gives
    each day's starting SOC per key, (3) every (key, day) walks from its start — all days in
    parallel, a hot key split by day, exact up to float reassociation."""
    tie = list(tie)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = with_prev(df.select(F.col(key), F.col(ts), *tie, F.col(net_kw).cast("double").alias("_net")),
                  [key], ts, [], tie=tie, unit=unit)
    hours = F.coalesce(seconds_between(ts, f"prev_{ts}") / 3600.0, F.lit(0.0))
    steps = p.select(key, ts, *tie, F.date_trunc(unit, F.col(ts)).alias("_day"),
                     (-F.col("_net") * hours / capacity_kwh * 100.0).alias("_d"))
    order = [key, "_day", ts] + tie
    ordered = steps.repartition(n, key, "_day").sortWithinPartitions(*order)
    day_schema = (f"{key} {steps.schema[key].dataType.simpleString()}, "
                  f"_day {steps.schema['_day'].dataType.simpleString()}, "
                  "_D double, _L double, _H double")

    def compose(batches):
        cur, D, L, H = None, 0.0, -math.inf, math.inf
        rows = []
        for pdf in batches:
            for k, day, d in zip(pdf[key], pdf["_day"], pdf["_d"]):
                if cur is None or (k, day) != cur:
                    if cur is not None:
                        rows.append((cur[0], cur[1], D, L, H))
                    cur, D, L, H = (k, day), 0.0, -math.inf, math.inf
                D, L, H = D + d, min(max(L + d, lo), hi), min(max(H + d, lo), hi)
            if len(rows) >= 10_000:
                yield pd.DataFrame(rows, columns=[key, "_day", "_D", "_L", "_H"])
                rows = []
        if cur is not None:
            rows.append((cur[0], cur[1], D, L, H))
        yield pd.DataFrame(rows, columns=[key, "_day", "_D", "_L", "_H"])

    days = ordered.mapInPandas(compose, schema=day_schema)
    start_schema = (f"{key} {steps.schema[key].dataType.simpleString()}, "
                    f"_day {steps.schema['_day'].dataType.simpleString()}, _start double")

    def starts(batches):
        # day summaries streamed in (key, day) order: one row per day of a key
        cur, x = object(), soc0
        for pdf in batches:
            out = []
            for k, D, L, H in zip(pdf[key], pdf["_D"], pdf["_L"], pdf["_H"]):
                if k != cur:
                    cur, x = k, soc0
                out.append(x)
                x = min(max(x + D, L), H)
            yield pd.DataFrame({key: pdf[key], "_day": pdf["_day"], "_start": out})

    begin = days.repartition(n, key).sortWithinPartitions(key, "_day") \
        .mapInPandas(starts, schema=start_schema)
    seeded = steps.join(begin, on=[key, "_day"], how="left") \
        .repartition(n, key, "_day").sortWithinPartitions(*order)
    out_schema = ", ".join(f"{c} {steps.schema[c].dataType.simpleString()}"
                           for c in [key, ts] + tie) + ", soc double"

    def walk(batches):
        cur, x = None, soc0
        for pdf in batches:
            out = []
            for k, day, d, st in zip(pdf[key], pdf["_day"], pdf["_d"], pdf["_start"]):
                if cur is None or (k, day) != cur:
                    cur, x = (k, day), st
                x = min(max(x + d, lo), hi)
                out.append(x)
            yield pd.DataFrame({**{c: pdf[c] for c in [key, ts] + tie}, "soc": out})

    return seeded.mapInPandas(walk, schema=out_schema)


# ------------------------------------------------------------------ sequences -----------------

def counter_delta(df: DataFrame, keys: Sequence[str], ts: str, counter: str,
                  tie: Sequence[str] = (), unit: str = "day") -> DataFrame:
    """Increment of a cumulative counter since the previous reading (W5); after a reset
    (value below the previous) the increment is the value itself; the first reading adds 0."""
    p = with_prev(df, list(keys), ts, [counter], tie=tie, unit=unit)
    v, pv = F.col(counter), F.col(f"prev_{counter}")
    delta = F.when(pv.isNull(), F.lit(0.0)).when(v < pv, v).otherwise(v - pv)
    return p.withColumn("delta", delta.cast("double")).drop(f"prev_{ts}", f"prev_{counter}")


def flag_intervals(df: DataFrame, keys: Sequence[str], ts: str, flag: str,
                   reason: str | None = None, tie: Sequence[str] = (), unit: str = "day"
                   ) -> DataFrame:
    """Episodes of consecutive flagged readings per key (W6): start (first flagged reading),
    end (first following unflagged reading, NULL while open), duration in seconds, readings,
    reason (of the first reading).

    Gaps and islands in one pass: every row is labelled with the last *unflagged* row strictly
    before it (a skew-safe forward fill); an episode is the flagged rows sharing a label, and
    its end is the unflagged row carrying the same label. Unflagged rows that follow an unflagged
    one are dropped before the episodes are grouped."""
    keys, tie = list(keys), list(tie)
    f = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    pos = F.struct(F.col(ts).alias("t"), *[F.col(c) for c in tie])
    labelled = ffill(df, keys, ts, F.when(~f, pos), "_ep", order=tie, unit=unit, strict=True,
                     lagged=f)
    labelled = labelled.filter(f | F.coalesce(F.col("_lagged"), F.lit(True)))
    aggs = [F.count_if(f).alias("readings"),
            F.min(F.when(f, F.col(ts))).alias("start_ts"),
            F.min(F.when(~f, F.col(ts))).alias("end_ts")]
    if reason:
        aggs.append(F.min(F.when(f, F.struct(pos.alias("o"), F.col(reason).alias("r"))))["r"]
                    .alias("reason"))
    ep = labelled.groupBy(*keys, "_ep").agg(*aggs).filter(F.col("readings") > 0)
    return ep.select(*keys, "start_ts", "end_ts",
                     seconds_between("end_ts", "start_ts").alias("duration_s"), "readings",
                     *(["reason"] if reason else []))


def tracking_error(df: DataFrame, keys: Sequence[str], ts: str, actual: str, target: str,
                   window_seconds: int) -> DataFrame:
    """Actual minus target and its moving average over the last ``window_seconds``.

    The RANGE frame runs per (key, day); rows from the last ``window_seconds`` of a day are
    also given to the next day as context, so the frame is exact across midnight and a hot key
    is split by day."""
    keys = list(keys)
    err = F.col(actual) - F.col(target)
    x = with_context(df.withColumn("error", err), keys, ts, window_seconds)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys, "_cb").orderBy(micros) \
        .rangeBetween(-int(window_seconds) * 1_000_000, 0)
    return x.withColumn("ma_error", F.avg("error").over(w)).filter(~F.col("_ctx")) \
        .drop("_cb", "_ctx")


def first_change(changes: DataFrame, events: DataFrame, keys: Sequence[str], ts: str,
                 signal: str, lookback_seconds: int, event_id: str) -> DataFrame:
    """For each event, the signal that changed first within ``lookback_seconds`` before it.

    Changes and events share one time-ordered stream per (key, day) — changes near the end
    of a day are also copied into the next day — and a RANGE frame ending just before the
    event gives the earliest change in the window."""
    keys = list(keys)
    c = changes.select(*keys, F.col(ts), F.struct(F.col(ts).alias("t"),
                                                  F.col(signal).alias("s")).alias("_c"),
                       F.lit(None).cast(events.schema[event_id].dataType).alias(event_id))
    e = events.select(*keys, F.col(ts), F.lit(None).cast(c.schema["_c"].dataType).alias("_c"),
                      F.col(event_id))
    u = with_context(c.unionByName(e), keys, ts, lookback_seconds)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*keys, "_cb").orderBy(micros) \
        .rangeBetween(-lookback_seconds * 1_000_000, -1)
    out = u.withColumn("_first", F.min("_c").over(w)) \
        .filter(F.col(event_id).isNotNull() & ~F.col("_ctx"))
    return out.select(*keys, event_id, F.col(ts).alias("event_ts"),
                      F.col("_first.s").alias("first_signal"),
                      F.col("_first.t").alias("first_change_ts"))


# ------------------------------------------------------------------ KPI views -----------------

def site_kpis(df: DataFrame, signals: Sequence[str], every: str = "5 minutes",
              ts: str = "event_time", site: str = "site", signal: str = "signal_name",
              value: str = "value_numeric") -> DataFrame:
    """Average of each listed signal per site and tumbling bucket, one column per signal
    (A10). The pivot list is fixed, so no extra pass collects the signal names."""
    return (df.filter(F.col(signal).isin(list(signals)))
            .groupBy(site, F.window(F.col(ts), every).start.alias("bucket_start"))
            .pivot(signal, list(signals)).agg(F.avg(value)))


def site_kpis_daily(kpis: DataFrame, signals: Sequence[str], price: str, load: str,
                    site: str = "site") -> DataFrame:
    """Daily averages of the bucket KPIs plus an energy-cost proxy Σ price·load."""
    aggs = [F.avg(F.col(s)).alias(f"avg_{s}") for s in signals]
    cost = F.sum(F.coalesce(F.col(price), F.lit(0.0)) * F.coalesce(F.col(load), F.lit(0.0)))
    return kpis.groupBy(site, F.to_date("bucket_start").alias("day")).agg(
        *aggs, F.count(F.lit(1)).alias("buckets"), cost.alias("cost_proxy"))


def forecast_accuracy(fva: DataFrame, every: str = "1 hour") -> DataFrame:
    """Per bucket of target time: MAE, MAPE, bias and mean confidence."""
    return (fva.filter(F.col("actual").isNotNull())
            .groupBy(F.window("target_time", every).start.alias("bucket_start"))
            .agg(F.avg(F.abs("error")).alias("mae"), F.avg("abs_pct_error").alias("mape"),
                 F.avg("error").alias("bias"), F.avg("confidence").alias("mean_confidence"),
                 F.count(F.lit(1)).alias("n")))
