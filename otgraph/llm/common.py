"""Helpers shared by the text operators: bounded batches, vectorised words and hashes, and the
shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from otgraph.session import ensure_checkpoint_dir

#: Characters handed to numpy at a time inside a task; a longer single text is its own chunk.
CHUNK_CHARS = 2_000_000

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh folder path below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: computed once, lineage cut, so a
    lost executor rereads files."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_dropped(spark: SparkSession):
    """Spark removes the shuffle files of a job that ends within, instead of when the driver next collects garbage: for large
    shuffles whose rows are then in a written table or at the driver."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, size: str = "2m"):
    """Jobs within hand rows to Python workers in Arrow batches of about ``size`` bytes (or one larger row), instead of 10,000 rows:
    executor and worker each hold a whole batch."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def text_key(text: Column) -> Column:
    """64-bit content hash; with the document id it names a row (identical rows share it and
    get identical verdicts). Null and empty text differ."""
    return F.xxhash64(text.isNull(), text)


#: Different texts of one id that a sample takes at most.
TEXTS_PER_ID = 4


def sample_texts(docs: DataFrame, ids: DataFrame, rows: int, chars: int) -> list[tuple[int, str]]:
    """(doc_id, text), different texts of the ``rows`` first ids (``doc_id``) in hash order, first one of each
    id, then others, texts of over an eighth of ``chars`` last. At most ``rows`` texts of ``chars`` characters in all; a
    text that does not fit is passed over, but if none fits the shortest found is taken whole."""
    rank = F.xxhash64("doc_id")
    ids = ids.select("doc_id").orderBy(rank, "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    texts = texts.withColumn("_k", text_key(F.col("text")))
    sizes = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "_k").agg(F.max(F.char_length("text")).alias("n"))
    nth = sizes.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("_k"))).where(F.col("_nth") <= TEXTS_PER_ID)
    keep, total = [], 0
    found = nth.orderBy("_nth", rank, "doc_id").limit(rows).collect()       # bounded by the parameter
    for r in sorted(found, key=lambda r: 8 * r["n"] > chars):               # very long ones come last
        if total + r["n"] <= chars:
            total += r["n"]
            keep.append((r["doc_id"], r["_k"]))
    if found and not keep:
        r = min(found, key=lambda r: (r["n"], r["doc_id"], r["_k"]))
        keep.append((r["doc_id"], r["_k"]))
    chosen = docs.sparkSession.createDataFrame(keep, "doc_id long, _k long")
    got = texts.join(F.broadcast(chosen), ["doc_id", "_k"]).dropDuplicates(["doc_id", "_k"])
    return sorted((r["doc_id"], r["text"]) for r in got.toLocalIterator())


def chunked(texts: list, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices [a, b) of ``texts`` of at most ``limit`` characters (or one longer text)."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > a and size + n > limit:
            yield a, i
            a, size = i, 0
        size += n
    if len(texts) > a:
        yield a, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising mixer over uint64 (wraps around)."""
    h = (h ^ (h >> _U(30))) * _M1
    h = (h ^ (h >> _U(27))) * _M2
    return h ^ (h >> _U(31))


# ---- words: [^\x20\x09-\x0D]+ -------------------------------------------------------------
_SEP = np.zeros(256, bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += _U(32)                       # A-Z only
_PLAIN = np.arange(256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15 | 1)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = _U(1)
    return np.cumprod(out)


class Words:
    """Words of some texts as arrays: ``buf`` the UTF-8 bytes, ``start``/``end`` byte ranges,
    ``doc`` the text each word belongs to, ``hash`` a 64-bit hash of its (lower-cased A-Z)
    bytes."""

    def __init__(self, texts: list, lower: bool = True):
        enc = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.buf = np.frombuffer(b" " + b" ".join(enc) + b" ", np.uint8)
        sizes = np.fromiter((len(e) + 1 for e in enc), np.int64, len(enc))
        self.text_start = 1 + np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(enc) else np.zeros(0, np.int64)
        self.sep = _SEP[self.buf]
        word = ~self.sep
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.n = len(self.start)
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(texts)) if self.n else np.zeros(len(texts), np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))
        lens = self.end - self.start
        self.lens = lens
        if self.n:
            at = np.concatenate(([0], np.cumsum(lens)[:-1]))
            off = np.arange(int(lens.sum())) - np.repeat(at, lens)
            vals = (_LOWER if lower else _PLAIN)[self.buf[word]] + _U(1)
            h = np.add.reduceat(vals * powers(int(lens.max()))[off], at)
            self.hash = mix(h + lens.astype(np.uint64) * _M1)
        else:
            self.hash = np.zeros(0, np.uint64)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, and the index of each run's first
        word."""
        if self.n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(self.n - k + 1, np.uint64)
        for j in range(k):
            h = mix(h + self.hash[j:self.n - k + 1 + j])
        ok = np.flatnonzero(self.doc[:self.n - k + 1] == self.doc[k - 1:])
        return h[ok], ok
