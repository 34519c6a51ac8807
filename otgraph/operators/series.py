"""Exact, skew-safe building blocks for per-key time series.

A window partitioned by the key alone puts a hot key's whole history in one task. These
helpers partition by (key, time bucket) instead. What a bucket needs from earlier buckets comes
from a small aggregate of the input (one row per key and bucket, combined before its shuffle)
and enters the bucket's window as one extra leading row, which is dropped afterwards: the
rows themselves are shuffled and sorted once, and keys compare as groups do (NULL is a key).
Results are exact while a hot key is split over as many tasks as it has buckets; choose a
smaller ``unit`` for denser data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET = "_bucket"


def _bucket(ts: str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts))


def _led(rows: DataFrame, carry: DataFrame, keys, ts, order):
    """``rows`` and the carried rows before them, and the window of a bucket."""
    u = rows.withColumn("_real", F.lit(True)).unionByName(
        carry.withColumn("_real", F.lit(False)), allowMissingColumns=True)
    return u, Window.partitionBy(*keys, BUCKET).orderBy("_real", *[F.col(c) for c in [ts] + list(order)])


def with_prev(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
              tie: Sequence[str] = (), unit: str = "day", prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<c>`` for ``ts`` and each column: the previous row of the same key in
    (ts, *tie) order, NULL for the first row."""
    keys, cols, tie = list(keys), list(cols), list(tie)
    carried = [ts] + [c for c in tie if c != ts] + [c for c in cols if c not in tie and c != ts]
    rec = F.struct(*[F.col(c).alias(c) for c in carried])
    rows = df.withColumn(BUCKET, _bucket(ts, unit))
    ends = rows.groupBy(*keys, BUCKET).agg(F.max_by(rec, F.struct(ts, *tie)).alias("_last"))
    wb = Window.partitionBy(*keys).orderBy(BUCKET)
    carry = ends.select(*keys, BUCKET, F.lag("_last").over(wb).alias("_rec")).filter("_rec is not null")
    u, w = _led(rows.withColumn("_rec", rec), carry, keys, ts, tie)
    out = u.withColumn("_prev", F.lag("_rec").over(w)).filter("_real")
    out = out.withColumns({f"{prefix}{c}": F.col("_prev")[c] for c in [ts] + cols})
    return out.drop("_prev", "_rec", "_real", BUCKET)


def ffill(df: DataFrame, keys: Sequence[str], ts: str, value: Column, name: str,
          order: Sequence[str] = (), unit: str = "day", strict: bool = False,
          lagged: Column | None = None) -> DataFrame:
    """Add ``name``: the last non-NULL ``value`` (any orderable type) of the same key at or before
    each row (strictly before with ``strict``), in (ts, *order) order. ``lagged`` adds
    ``_lagged``: that expression on the row before within the bucket, NULL on its first row."""
    keys, order = list(keys), list(order)
    rows = df.withColumn(BUCKET, _bucket(ts, unit)).withColumn("_v", value)
    if lagged is not None:
        rows = rows.withColumn("_l", lagged)
    last = F.max(F.when(F.col("_v").isNotNull(), F.struct(F.col(ts).alias("t"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                                                          F.col("_v").alias("v"))))
    ends = rows.groupBy(*keys, BUCKET).agg(last.alias("_e"))
    wb = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, BUCKET, F.last("_e", ignorenulls=True).over(wb)["v"].alias("_v")).filter("_v is not null")
    u, w = _led(rows, carry, keys, ts, order)
    frame = w.rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    out = u.withColumn(name, F.last("_v", ignorenulls=True).over(frame))
    if lagged is not None:
        out = out.withColumn("_lagged", F.lag("_l").over(w)).drop("_l")
    return out.filter("_real").drop("_v", "_real", BUCKET)


def with_context(df: DataFrame, keys: Sequence[str], ts: str, seconds: int,
                 unit_seconds: int | None = None) -> DataFrame:
    """Rows tagged with a bucket (``_cb``) plus, for rows in the last ``seconds`` of their
    bucket, a context copy (``_ctx`` true) in the next bucket — so a RANGE frame reaching
    ``seconds`` back can run per (key, bucket) and stay exact. The bucket is a day, or the
    look-back if that is longer."""
    unit_seconds = max(unit_seconds or 86_400, int(seconds))
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    b = F.floor(sec / unit_seconds)
    near_end = (sec - b * unit_seconds) >= (unit_seconds - seconds)
    copies = F.when(near_end, F.array(F.struct(b.alias("cb"), F.lit(False).alias("ctx")),
                                      F.struct((b + 1).alias("cb"), F.lit(True).alias("ctx")))) \
        .otherwise(F.array(F.struct(b.alias("cb"), F.lit(False).alias("ctx"))))
    return df.withColumn("_copy", F.explode(copies)) \
        .withColumn("_cb", F.col("_copy.cb")).withColumn("_ctx", F.col("_copy.ctx")).drop("_copy")


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    a = F.col(later) if isinstance(later, str) else later
    b = F.col(earlier) if isinstance(earlier, str) else earlier
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6
