"""Sinks: N-Triples text, versioned snapshots."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from otgraph.functions.iri import RDF_TYPE, RDF_TYPE_IRI, clean_uri
from otgraph.operators.triples import latest_triples


def _escape_literal(c: Column) -> Column:
    for a, b in [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def ntriples_lines(df: DataFrame) -> DataFrame:
    """One N-Triples line per triple (S12): IRIs cleaned and bracketed, the type predicate
    written in full, objects of the type predicate as IRIs, other objects as escaped literals.
    N-Triples is line-splittable, so the text can be written and read in parallel."""
    is_type = F.col("p").isin(RDF_TYPE, RDF_TYPE_IRI)
    s = F.concat(F.lit("<"), clean_uri("s"), F.lit(">"))
    p = F.when(is_type, F.lit(f"<{RDF_TYPE_IRI}>")).otherwise(
        F.concat(F.lit("<"), clean_uri("p"), F.lit(">")))
    o = F.when(is_type, F.concat(F.lit("<"), clean_uri("o"), F.lit(">"))).otherwise(
        F.concat(F.lit('"'), _escape_literal(F.col("o")), F.lit('"')))
    return df.select(F.concat_ws(" ", s, p, o, F.lit(".")).alias("value"))


def write_ntriples(df: DataFrame, path: str) -> None:
    ntriples_lines(df).write.mode("overwrite").text(path)


def write_triples(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Store triples partitioned by event date, so point-in-time and recent-window queries read
    only the days they need."""
    df.withColumn("date", F.to_date(F.col(ts))).write.mode(mode).partitionBy("date").parquet(path)


def write_snapshot(df: DataFrame, base: str, version: str | None = None) -> str:
    """Write ``df`` to a fresh folder ``<base>/v=<version>-<id>`` and append a pointer to it
    (S14, T5). Nothing that a reader may use is overwritten: pointers are small tables of their
    own, committed as any Spark output is, and the greatest complete one counts."""
    spark = df.sparkSession
    version = version or f"{time.time_ns():020d}"
    target = f"{base.rstrip('/')}/v={version}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(target)
    number = (_pointer(spark, base) or (0, ""))[0] + 1
    spark.createDataFrame([(number, target)], "number long, target string").coalesce(1) \
        .write.mode("append").parquet(_pointers(base))
    return target


def _pointers(base: str) -> str:
    return f"{base.rstrip('/')}/_pointers"


def _pointer(spark: SparkSession, base: str) -> tuple[int, str] | None:
    """(number, folder) of the current snapshot; None if none was ever written. Errors other than
    a missing pointer folder are raised."""
    try:
        rows = spark.read.schema("number long, target string").option("recursiveFileLookup", "true").parquet(_pointers(base))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    best = rows.agg(F.max(F.struct("number", "target")).alias("p")).first()["p"]
    return tuple(best) if best else None


def has_snapshot(spark: SparkSession, base: str) -> bool:
    return _pointer(spark, base) is not None


def read_snapshot(spark: SparkSession, base: str) -> DataFrame:
    current = _pointer(spark, base)
    if current is None:
        raise FileNotFoundError(f"no snapshot in {base}")
    return spark.read.parquet(current[1])


def sync_latest(triples: DataFrame, base: str, version: str | None = None) -> str:
    """Snapshot of the newest triple per (s, p)."""
    return write_snapshot(latest_triples(triples), base, version)

