"""A registry kept with trigram postings, so that a text search reads postings and candidates only.

``models/part=<hash of id>`` holds the rows, ``postings/bucket=<hash of gram>`` rows (gram, part, ids): for every
distinct lower-case trigram of name, description and content the rows that hold it, those of a part in one or more lists;
``grams/bucket=..`` how many rows hold each trigram. A trigram is a number, its three code points in 21 bits each. A search takes the rarest trigrams of its text, intersects their postings, reads the candidates' parts and verifies them
with the plain condition, so it returns what a scan returns. Texts without three characters between wildcards are scanned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from otgraph.operators.models import search_condition

FIELDS = ("name", "description", "content")
#: Trigrams of a search text that are looked up: the rarest, as more would hardly thin out the candidates.
RAREST = 4
#: Trigrams, repeated per row, that are put in order at a time.
GRAMS_HELD = 2_000_000


def trigrams(*texts: str | None) -> np.ndarray:
    """Distinct trigrams of some lower-case texts, as numbers."""
    out = []
    for t in texts:
        if t is not None and len(t) > 2:
            c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            out.append(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _postings(part: int, ids: pa.Array, grams: list[np.ndarray]) -> pa.RecordBatch:
    """(part, gram, ids): the rows that hold each trigram."""
    all_, row = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    order = np.argsort(all_, kind="stable")
    all_ = all_[order]
    at = np.flatnonzero(np.concatenate(([True], all_[1:] != all_[:-1]))) if len(all_) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(all_)).astype(np.int32)), ids.take(pa.array(row[order])))
    return pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array(all_[at]), lists], names=["part", "gram", "ids"])


class ModelIndex:
    def __init__(self, spark: SparkSession, base: str, buckets: int = 32, parts: int = 32):
        self.spark, self.base, self.buckets, self.parts = spark, base.rstrip("/"), buckets, parts

    def _bucket(self, gram: Column) -> Column:
        return F.pmod(F.xxhash64(gram), F.lit(self.buckets)).cast("int")

    def build(self, models: DataFrame) -> ModelIndex:
        """Write the registry and its postings below a base that holds none yet."""
        models.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(self.parts)).cast("int")).repartition("part") \
            .write.partitionBy("part").parquet(f"{self.base}/models")
        rows = self.spark.read.parquet(f"{self.base}/models")
        id_type = rows.schema["id"].dataType.simpleString()

        def run(batches):
            for batch in batches:
                part = batch.column("part").to_pylist()
                held, first, size = [], 0, 0
                for i, texts in enumerate(zip(*[batch.column(c).to_pylist() for c in FIELDS])):
                    held.append(trigrams(*texts))
                    size += len(held[-1])
                    last = i + 1 == batch.num_rows
                    if size >= GRAMS_HELD or last or part[i + 1] != part[i]:
                        yield _postings(part[i], batch.column("id").slice(first, len(held)), held)
                        held, first, size = [], i + 1, 0

        grams = rows.select("part", "id", *[F.lower(c).alias(c) for c in FIELDS]).mapInArrow(run, f"part int, gram long, ids array<{id_type}>")
        postings = grams.withColumn("bucket", self._bucket(F.col("gram")))
        # by bucket and part: the postings of a gram that a third of the rows holds are spread over files, and nothing is read to deal them
        postings.repartition("bucket", "part").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.base}/postings")
        counts = self.spark.read.parquet(f"{self.base}/postings").groupBy("bucket", "gram").agg(F.sum(F.size("ids")).alias("n"))
        counts.repartition("bucket").sortWithinPartitions("gram").write.partitionBy("bucket").parquet(f"{self.base}/grams")
        return self

    def _read(self, table: str, wanted: list[tuple[int, int]]) -> DataFrame:
        return (self.spark.read.parquet(f"{self.base}/{table}")
                .where(F.col("bucket").isin(sorted({b for _, b in wanted})) & F.col("gram").isin([g for g, _ in wanted])))

    def candidates(self, text: str) -> DataFrame | None:
        """(part, id) of the rows that hold the rarest trigrams of the text; None if it has no trigram."""
        # between the wildcards of LIKE
        parts = self.spark.range(1).select(F.transform(F.split(F.lit(text), r"[%_\\]"), F.lower).alias("x")).first()["x"]
        grams = F.array(*[F.lit(g) for g in trigrams(*parts).tolist()]).cast("array<bigint>")
        found = self.spark.range(1).select(F.explode(grams).alias("g")).select("g", self._bucket(F.col("g")).alias("b")).collect()
        if not found:
            return None
        counts = {r["gram"]: r["n"] for r in self._read("grams", [tuple(r) for r in found]).collect()}     # a row per trigram of the text
        rare = sorted(found, key=lambda r: (counts.get(r["g"], 0), r["g"]))[:RAREST]
        if not counts.get(rare[0]["g"]):
            return self.spark.createDataFrame([], "part int, id int")
        rows = self._read("postings", [tuple(r) for r in rare]).select("part", F.explode("ids").alias("id")).groupBy("part", "id").agg(F.count("*").alias("n"))
        return rows.where(F.col("n") == len(rare)).select("part", "id")

    def search(self, text: str, category: str | None = None) -> DataFrame:
        """The registry rows that :func:`search_condition` selects."""
        rows, found = self.spark.read.parquet(f"{self.base}/models"), self.candidates(text)
        if found is not None:
            rows = rows.join(found, ["part", "id"], "left_semi")
        return rows.where(search_condition(category, text)).drop("part")
