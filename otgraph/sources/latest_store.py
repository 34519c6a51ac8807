"""The newest row per key, kept current at a cost that follows the change.

Keys are dealt to hash buckets. A bucket has a base file, one row per key, and the delta files of later batches. A
batch is reduced to its newest row per key and written once, to the buckets it touches only. When the deltas
of a bucket exceed ``share`` of its base, that bucket alone is merged into a new base: a row is rewritten
about 1 / ``share`` times per doubling of its bucket, however large the table. Reading takes the
base files of buckets without deltas as they are and reduces the rest.

Ties on the timestamp go to the greater values, as in ``latest_by``. Null keys are keys of their own. A batch of an
``origin`` whose epoch is not greater than the last one committed for it is a replay and changes nothing.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from otgraph.operators.triples import latest_by
from otgraph.sources.versions import File, Versions

BASE, DELTA, EPOCH = "base", "delta", "epoch"
BUCKET = "hash_bucket"              # folder column; not a column of the data


class LatestStore:
    """``keys`` identify a row; ``bucket_by`` (some of them) choose its bucket, so everything about one subject stands
    in one bucket; ``buckets`` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, base: str, keys: Sequence[str] = ("s", "p"), ts: str = "timestamp",
                 bucket_by: Sequence[str] = ("s",), buckets: int = 64, share: float = 0.5):
        self.spark, self.keys, self.ts, self.bucket_by, self.buckets, self.share = spark, list(keys), ts, list(bucket_by), buckets, share
        self.versions = Versions(spark, base)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.bucket_by]), F.lit(self.buckets)).cast("int")

    def _latest(self, df: DataFrame) -> DataFrame:
        values = [c for c in df.columns if c not in (*self.keys, self.ts, BUCKET)]
        return latest_by(df, self.keys, self.ts, values).select(*[c for c in df.columns if c != BUCKET])

    def _write(self, rows: DataFrame, kind: str, number: int) -> dict[str, File]:
        """Rows written to one file per bucket; what was written, by bucket."""
        path = f"data/{number:012d}-{kind}-{uuid.uuid4().hex[:12]}"
        full = f"{self.versions.base}/{path}"
        rows.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(full)
        counts = self.spark.read.schema(f"{BUCKET} int").parquet(full).groupBy(BUCKET).count().collect()    # a row per bucket
        return {str(b): File(kind, str(b), f"{path}/{BUCKET}={b}", n) for b, n in counts}

    def merge(self, batch: DataFrame, origin: str = "", epoch: int | None = None) -> list[str]:
        """Bring a batch in. Returns the buckets whose base was rewritten."""
        if BUCKET in batch.columns:
            raise ValueError(f"{BUCKET} is the store's own column")
        number = self.versions.number()
        files = self.versions.files(number)
        if epoch is not None and any(f.kind == EPOCH and f.part == origin and f.rows >= epoch for f in files):
            return []
        new = self._write(self._latest(batch), DELTA, number + 1)
        held = defaultdict(list)
        for f in files:
            if f.kind != EPOCH:
                held[f.part].append(f)
        for b, f in new.items():
            held[b].append(f if held[b] else f._replace(kind=BASE))        # the first rows of a bucket are its base
        due = {b for b, fs in held.items() if sum(f.rows for f in fs if f.kind == DELTA) > self.share * sum(f.rows for f in fs if f.kind == BASE)}
        if due:
            rows = self._latest(self._rows([f for b in sorted(due) for f in held[b]]))
            held.update({b: [f] for b, f in self._write(rows, BASE, number + 1).items()})
        epochs = [f for f in files if f.kind == EPOCH and (epoch is None or f.part != origin)]
        if epoch is not None:
            epochs.append(File(EPOCH, origin, "", epoch))
        self.versions.commit(number, [f for fs in held.values() for f in fs] + epochs)
        return sorted(due)

    def _rows(self, files: list[File]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.versions.base}/{f.path}" for f in files])

    def _current(self, files: list[File]) -> DataFrame:
        held = defaultdict(list)
        for f in files:
            if f.kind != EPOCH:
                held[f.part].append(f)
        if not held:
            raise FileNotFoundError(f"no rows in {self.versions.base}")
        still = [fs[0] for fs in held.values() if len(fs) == 1]
        moved = [f for fs in held.values() if len(fs) > 1 for f in fs]
        if not moved:
            return self._rows(still)
        changed = self._latest(self._rows(moved))
        return self._rows(still).unionByName(changed) if still else changed

    def read(self, number: int | None = None) -> DataFrame:
        """The newest row per key, now or as of an earlier commit."""
        return self._current(self.versions.files(number))

    def lookup(self, **values) -> DataFrame:
        """Rows of given ``bucket_by`` values: only their bucket is read."""
        if sorted(values) != sorted(self.bucket_by):
            raise ValueError(f"need values of {self.bucket_by}")
        at = self.spark.range(1).select(*[F.lit(values[c]).alias(c) for c in self.bucket_by]).select(self._bucket().alias("b")).first()["b"]
        files = [f for f in self.versions.files() if f.kind != EPOCH and f.part == str(at)]
        rows = self._current(files) if files else self.read().limit(0)
        for c, v in values.items():
            rows = rows.where(F.col(c).eqNullSafe(F.lit(v)))
        return rows
