"""Latest / point-in-time triples, sensor selection, state map and pivots (A1-A3, W1, W2, F10,
U2, A5, P13).

Latest-per-key uses ``max(struct(timestamp, o))`` in a ``groupBy``: the aggregation is partial
on the map side, so only one row per key and task is shuffled and a key holding a third of all
rows costs no more than any other key. Ties on the timestamp go to the greater object.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from otgraph.functions.iri import (component_id_from_iri, is_type_predicate, local_name,
                                   state_value_number, state_value_text)


def _ts_lit(ts) -> Column:
    if isinstance(ts, Column):
        return ts
    if isinstance(ts, str):
        return F.to_timestamp(F.lit(ts))
    return F.lit(ts)


def latest_by(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str],
              tie: Sequence[str] | None = None) -> DataFrame:
    """Newest row per key: returns keys, ``ts`` and ``values`` of the winning row.

    Ordering is (ts, *tie); by default the values themselves break ties, greatest first.
    """
    tie = list(tie) if tie is not None else [v for v in values if v != ts]
    order = [ts] + [t for t in tie if t != ts]
    carried = order + [v for v in values if v not in order]
    best = F.max(F.struct(*[F.col(c) for c in carried])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_best")[c].alias(c)
                                                     for c in [ts] + [v for v in values if v != ts]])


def latest_triples(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Newest object per (s, p) with its timestamp (A1)."""
    return latest_by(df, ["s", "p"], ts, ["o"]).select("s", "p", "o", ts)


def point_in_time(df: DataFrame, at, ts: str = "timestamp", date_col: str = "date"
                  ) -> DataFrame:
    """Newest object per (s, p) strictly before ``at`` (W1). The filter reaches the scan; on a
    triple table partitioned by ``date`` (see ``sources.sinks.write_triples``) the same bound
    on the partition column prunes every later day's files."""
    cond = F.col(ts) < _ts_lit(at)
    if date_col in df.columns:
        cond = (F.col(date_col) <= F.to_date(_ts_lit(at))) & cond
    return latest_triples(df.filter(cond), ts)


def sensor_triples(df: DataFrame, predicates: Sequence[str], subject_prefix: str) -> DataFrame:
    """Triples of the given predicates on subjects under a prefix, object present."""
    return df.filter(
        F.col("p").isin(list(predicates))
        & F.col("s").startswith(subject_prefix)
        & F.col("o").isNotNull() & (F.col("o") != "None")
    )


def telemetry_from_triples(df: DataFrame, sensors: dict[str, str], subject_prefix: str,
                           ts: str = "timestamp") -> DataFrame:
    """Latest sensor triples pivoted to one row per component (A2).

    ``sensors`` maps output column → predicate IRI. A missing or non-numeric reading is 0.0.
    The row timestamp is the one of the alphabetically first predicate present.
    """
    lat = latest_triples(sensor_triples(df, list(sensors.values()), subject_prefix), ts)
    num = F.col("o").try_cast("double")
    aggs = [F.coalesce(F.max(F.when(F.col("p") == pred, num)), F.lit(0.0)).alias(name)
            for name, pred in sensors.items()]
    return (
        lat.groupBy("s")
        .agg(*aggs, F.min_by(F.col(ts), F.col("p")).alias(ts))
        .select(component_id_from_iri("s").alias("component_id"), *sensors.keys(), ts)
    )


def state_map(df: DataFrame) -> DataFrame:
    """Subject → {predicate local name: value} (A3).

    Numeric objects are rounded to two places (kept as text in the map), other objects are
    their text. Subjects that only carry a type get an empty map. Two predicates with the same
    local name resolve to the greater predicate IRI (then the greater object, so multi-valued
    predicates give one deterministic value). Entries are sorted by name.
    """
    entries = (
        df.select("s", "p", "o", F.when(~is_type_predicate("p"), local_name("p")).alias("k"))
        .groupBy("s", "k")
        .agg(F.max(F.struct("p", "o"))["o"].alias("o"))
        .select("s", "k", F.coalesce(state_value_number("o").cast("string"),
                                     state_value_text("o")).alias("v"))
    )
    entry = F.when(F.col("k").isNotNull(), F.struct("k", "v"))
    return entries.groupBy("s").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("state"))


def triple_set(df: DataFrame) -> DataFrame:
    """Graph set semantics: duplicates of (s, p, o) collapse."""
    return df.select("s", "p", "o").distinct()


def as_sensor_columns(df: DataFrame, sensors: dict[str, str]) -> DataFrame:
    """Alias readings to output names, NULL → 0.0 (P13). ``sensors`` maps output → input column."""
    return df.select(*[F.coalesce(F.col(src).cast("double"), F.lit(0.0)).alias(out)
                       for out, src in sensors.items()])


def latest_telemetry(df: DataFrame, sensors: dict[str, str], now, days: int = 30,
                     n: int | None = None, key: str = "component_id",
                     ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Newest telemetry row per component in the last ``days`` days.

    Every component is returned; a report that asks for ``n`` rows gets the first by component.
    """
    since = _ts_lit(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    order = [F.col(ts).desc()] + ([F.col(tie).desc()] if tie else [])
    w = Window.partitionBy(key).orderBy(*order)
    picked = (
        df.filter(F.col(ts) >= since)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .select(F.col(key).alias("component_id"),
                *[F.coalesce(F.col(src).cast("double"), F.lit(0.0)).alias(out)
                  for out, src in sensors.items()],
                F.col(ts).alias("timestamp"))
    )
    if n is None:
        return picked
    return picked.orderBy("component_id").limit(int(n))


def row_counts(df: DataFrame, key: str = "line_id", row_bytes: int = 500) -> DataFrame:
    """Rows per key and in total (key NULL), with the size estimate in MB (A5)."""
    return (
        df.rollup(key).agg(F.count(F.lit(1)).alias("rows"))
        .select(key, "rows", (F.col("rows") * F.lit(row_bytes) / F.lit(1_000_000.0)).alias("est_mb"))
    )


def order_by_component_property(df: DataFrame) -> DataFrame:
    """Sort by subject, predicate (L1)."""
    return df.orderBy("s", "p")

