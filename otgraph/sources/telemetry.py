"""Wide telemetry bronze: read, coerce, append, partial insert, legacy CSV, and the bronze →
triples mapping (S1-S4, S17, M1 for telemetry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from otgraph.functions.iri import DEFAULT_NS, component_iri, predicate_iri, type_iri
from otgraph.operators.mapping import TripleMapping
from otgraph.schemas import (LEGACY_CSV, TELEMETRY, TELEMETRY_PARTIAL_COLUMNS,
                             TELEMETRY_SENSORS)

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSS"


def read_telemetry(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Scan the wide bronze with its fixed 13-column schema."""
    reader = spark.read.schema(TELEMETRY).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path)


def with_event_time(df: DataFrame, col: str = "timestamp", out: str = "event_ts") -> DataFrame:
    """Parse the text timestamp once at the bronze boundary."""
    return df.withColumn(out, F.try_to_timestamp(F.col(col), F.lit(TS_FORMAT)))


def coerce_telemetry(raw: DataFrame) -> DataFrame:
    """Record coercion before ingest (S4): readings to double, ids and timestamp to text,
    damage flag to boolean, a missing ``abnormal_sensor`` to ''; columns in bronze order. A value
    that does not convert becomes NULL instead of failing the job."""
    cols = []
    for f in TELEMETRY.fields:
        c = F.col(f.name) if f.name in raw.columns else F.lit(None)
        if f.name == "abnormal_sensor":
            c = F.coalesce(c.cast("string"), F.lit(""))
        elif f.name == "timestamp" and f.name in raw.columns and \
                raw.schema[f.name].dataType.typeName().startswith("timestamp"):
            c = F.date_format(c, TS_FORMAT)
        cols.append(c.try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def append_telemetry(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a batch to the bronze."""
    df.select(*[f.name for f in TELEMETRY.fields]).write.mode("append").format(fmt).save(path)


def partial_rows(df: DataFrame) -> DataFrame:
    """Rows that carry only the live-feed columns, widened to the bronze schema with NULLs (S3)."""
    empty = df.sparkSession.createDataFrame([], TELEMETRY)
    return empty.unionByName(df.select(*TELEMETRY_PARTIAL_COLUMNS), allowMissingColumns=True) \
        .select(*[F.col(f.name).cast(f.dataType) for f in TELEMETRY.fields])


def append_partial(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Insert rows with 8 of the 13 columns; the rest are NULL (S3)."""
    partial_rows(df).write.mode("append").format(fmt).save(path)


def read_legacy_csv(spark: SparkSession, path: str) -> DataFrame:
    """The older 13-column CSV layout with ``sensor_*`` readings."""
    return spark.read.schema(LEGACY_CSV).option("header", "true").csv(path)


def telemetry_mapping(ns: str = DEFAULT_NS) -> TripleMapping:
    """The bronze → triples mapping: seven readings, damage flag as text, abnormal sensor;
    ``timestamp`` parsed to TIMESTAMP on every triple."""
    pos = {predicate_iri(s, ns): F.col(s) for s in TELEMETRY_SENSORS}
    pos[predicate_iri("damaged_component", ns)] = F.col("damaged_component").cast("string")
    pos[predicate_iri("abnormal_sensor", ns)] = F.col("abnormal_sensor")
    return TripleMapping(
        subject=component_iri("component_id", ns), rdf_type=type_iri("component", ns),
        predicate_objects=pos,
        metadata={"timestamp": F.try_to_timestamp(F.col("timestamp").cast("string"))})
