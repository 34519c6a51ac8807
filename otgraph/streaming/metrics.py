"""Ingest metrics of streams in a table (T7, A6): one row per query and epoch, written once.

A streaming query's ``observe`` counts (see ``ingest.observe_ingest``) arrive with its progress. The listener writes them to
``query=<id>/epoch=<n>``, a folder that only this epoch of this query writes: a progress event that is
delivered again, or an epoch that is run again after a restart from the checkpoint, replaces its own row.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

COUNTS = ("received", "good", "dropped", "filtered", "accepted")
_SCHEMA = "at string, run string, " + ", ".join(f"{c} long" for c in COUNTS)


class MetricsListener(StreamingQueryListener):
    """Writes the counts observed under ``name`` below ``path``. Use with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str, name: str = "ingest"):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self._ended: set[str] = set()
        self._news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is None:
            return
        values = (p.timestamp, str(p.runId), *[row[c] for c in COUNTS])
        self.spark.createDataFrame([values], _SCHEMA).coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.path}/query={p.id}/epoch={p.batchId}")

    def onQueryTerminated(self, event) -> None:
        with self._news:
            self._ended.add(str(event.runId))
            self._news.notify_all()

    def flush(self, query: StreamingQuery, timeout: float = 60.0) -> None:
        """Wait until every event of a query that has ended was written (events arrive in order)."""
        with self._news:
            if not self._news.wait_for(lambda: str(query.runId) in self._ended, timeout):
                raise TimeoutError(f"no end of query {query.id} after {timeout} s")


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """query, epoch, at, run and the counts of all epochs."""
    return spark.read.schema(f"{_SCHEMA}, query string, epoch long").parquet(path)


def total_metrics(metrics: DataFrame) -> DataFrame:
    """Sums per query, as ``silver.ingest_metrics`` counts them in batch."""
    return metrics.groupBy("query").agg(*[F.sum(c).alias(c) for c in COUNTS], F.count("*").alias("epochs"))
