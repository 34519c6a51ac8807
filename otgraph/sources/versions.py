"""Which files a table consists of, changed by whole commits.

A table kept below ``base`` (see ``latest_store`` and ``history``) never overwrites data: a commit writes its new
files, then a manifest, a one-file table ``_manifest/<number>`` that lists every file folder in use. The manifest
of the greatest number counts. Its file appears when Spark commits the write, so a reader sees a
commit whole or not at all, a crash in between leaves folders that nothing names, and two writers that start from the
same manifest cannot both commit. A manifest has a few rows per bucket or day, not per data row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class File(NamedTuple):
    """A folder in use: ``kind`` (of the table's choice), ``part`` (bucket or day), ``path`` below the base, ``rows``."""

    kind: str
    part: str
    path: str
    rows: int


_SCHEMA = "kind string, part string, path string, rows long"


class Versions:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def number(self) -> int:
        """The newest commit; 0 if there is none."""
        try:
            files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                     .option("pathGlobFilter", "*.parquet").load(f"{self.base}/_manifest").select("path"))
            return max((int(r["path"].split("/")[-2]) for r in files.collect()), default=0)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return 0
            raise

    def files(self, number: int | None = None) -> list[File]:
        number = self.number() if number is None else number
        if not number:
            return []
        rows = self.spark.read.schema(_SCHEMA).parquet(f"{self.base}/_manifest/{number:012d}").collect()
        return sorted(File(*r) for r in rows)

    def commit(self, after: int, files: list[File]) -> int:
        """Make ``files`` the table's, given that ``after`` is still the newest commit."""
        number = after + 1
        self.spark.createDataFrame([tuple(f) for f in files], _SCHEMA).coalesce(1) \
            .write.mode("errorifexists").parquet(f"{self.base}/_manifest/{number:012d}")
        return number

    def read(self, files: list[File], below: str) -> DataFrame:
        """The rows of some files, partition columns of the folders under ``below`` included."""
        return self.spark.read.option("basePath", f"{self.base}/{below}").parquet(*[f"{self.base}/{f.path}" for f in files])
