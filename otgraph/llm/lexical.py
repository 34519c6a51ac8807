"""Ranked lexical search: item vocabulary tiles times document impact tiles, multiplied densely.

Terms are the maximal stretches of letters and digits (and every character from U+0080), A-Z in lower case. An item's
score for a document sums, over the item's distinct terms, weight * impact:

    weight = floor(1000 * ln((2N + 2) / (2 df + 1)))         impact = 10^9 tf div (1000 tf + 8 m)
    m = 100 - 90 + (90 n N) div L

with N documents that have a term, L all their terms, df the documents that hold the term, n and tf a document's terms and
the term's occurrences in it.

1. Items are dealt to blocks of about ``BLOCK_TERMS`` (item, term) pairs by a hash of their id, so the number of
   blocks follows the item table; only one block's vocabulary is held or broadcast at a time.
2. One pass over the texts counts, per document, the block's terms (``postings``, written once). N, L and df are summed
   from it: every task sums its documents, Spark sums the tasks.
3. Every task multiplies tiles: ``DOC_TILE`` documents by the compact vocabulary of ``ITEM_TILE`` items, that vocabulary
   in tiles of at most ``TERM_TILE`` terms and of no more than keep a partial sum below 2^53, so float64 products
   are exact. Partial sums are added as 64-bit integers.
4. A task keeps the best ``top`` documents of every item by (score, doc_id): of a tile only scores that are at least
   the item's present last and the tile's own last can enter, equal ones included, so ties never
   depend on tiles. Spark ranks the tasks' rows, salted first.

Defined results: null, empty and term-less texts are no documents; rows repeated are documents of their own and rank one
by one; a null doc_id ranks after the others of its score; rows of one item_id are one item (null: an item of
its own); items without terms or without a hit give no rows; empty tables give no rows; extra columns of any
name are ignored. Very long texts are counted in pieces of ``PIECE_BYTES``.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otgraph.llm.common import written

TOP = 10
BLOCK_TERMS = 200_000
DOC_TILE, ITEM_TILE, TERM_TILE = 1024, 32, 2048
EXACT, IMPACT = 1 << 53, 1_000_000     # impacts are below 10^6
PIECE_BYTES = 1 << 20
SALTS = 32

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms in lower case, all others as blanks. UTF-8 writes characters from U+0080 in bytes from 0x80.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def count_terms(raw: bytes) -> Counter:
    """Occurrences of each term of a text."""
    if len(raw) <= PIECE_BYTES:
        return Counter(raw.translate(_TABLE).split())
    out, left = Counter(), b""
    for a in range(0, len(raw), PIECE_BYTES):
        piece = left + raw[a:a + PIECE_BYTES].translate(_TABLE)
        cut = piece.rfind(b" ") + 1
        out.update(piece[:cut].split())
        left = piece[cut:]
    out.update(left.split())
    return out


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct."""
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    return (items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))).alias("term"))
            .distinct())


class Block:
    """Items of a block: ``ids``, the vocabulary (``slot`` of each term) and every item's slots."""

    def __init__(self, pairs: list[tuple]):
        terms = sorted({t for _, t in pairs})
        self.slot = {t.encode(): i for i, t in enumerate(terms)}
        by: dict = {}
        for item, t in pairs:
            by.setdefault(item, []).append(self.slot[t.encode()])
        self.ids = sorted(by, key=lambda i: (i is None, i or 0))
        self.slots = [np.array(sorted(by[i]), np.int64) for i in self.ids]


def postings(docs: DataFrame, block) -> DataFrame:
    """doc_id, n (terms), and the slots and counts of the block's terms, of every document with a term."""
    def run(batches):
        vocabulary = block.value.slot
        for batch in batches:
            ids, n, slots, counts = [], [], [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                found = count_terms(raw or b"")
                if not found:
                    continue
                hit = [(vocabulary[t], found[t]) for t in vocabulary.keys() & found.keys()]
                hit.sort()
                ids.append(doc_id)
                n.append(found.total())
                slots.append(np.array([s for s, _ in hit], np.int32).tobytes())
                counts.append(np.array([c for _, c in hit], np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["doc_id", "n", "slots", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, "doc_id long, n long, slots binary, counts binary"), "lexical-postings")


def frequencies(rows: DataFrame, terms: int) -> np.ndarray:
    """Documents that hold each of the block's terms."""
    def run(batches):
        df = np.zeros(terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("slots").to_pylist()), np.int32), minlength=terms)
        slot = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(df[slot])], names=["slot", "df"])

    out = np.zeros(terms, np.int64)
    for r in rows.select("slots").mapInArrow(run, "slot long, df long").groupBy("slot").agg(F.sum("df").alias("df")).collect():
        out[r["slot"]] = r["df"]                               # at most the block's vocabulary
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms."""
    if 90 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 10 + 90 * n * n_docs // n_terms
    return np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], np.int64)


class Tiles:
    """Weight matrices of the item tiles: for each, its items, and per vocabulary tile its slots and the (terms, items)
    weights."""

    def __init__(self, block: Block, weight: np.ndarray):
        width = max(1, min(TERM_TILE, (EXACT - 1) // (IMPACT * max(1, int(weight.max(initial=1))))))
        self.tiles, self.width = [], len(weight)
        column = np.full(len(weight), -1, np.int32)
        for a in range(0, len(block.ids), ITEM_TILE):
            slots = block.slots[a:a + ITEM_TILE]
            vocabulary = np.unique(np.concatenate(slots))
            parts = []
            for v in range(0, len(vocabulary), width):
                terms = vocabulary[v:v + width]
                column[terms] = np.arange(len(terms), dtype=np.int32)
                w = np.zeros((len(terms), len(slots)))
                for j, s in enumerate(slots):
                    mine = column[s]
                    w[mine[mine >= 0], j] = weight[s[mine >= 0]]
                column[terms] = -1
                parts.append((terms, w))
            self.tiles.append((a, len(slots), parts))

    def scores(self, n: int, row: np.ndarray, slot: np.ndarray, impact: np.ndarray):
        """Per item tile: its first item and the (documents, items) scores of a tile of n documents."""
        column = np.full(self.width, -1, np.int32)             # of each slot in the vocabulary tile
        for a, items, parts in self.tiles:
            total = np.zeros((n, items), np.int64)
            for terms, w in parts:
                column[terms] = np.arange(len(terms), dtype=np.int32)
                at = column[slot]
                column[terms] = -1
                on = at >= 0
                dense = np.zeros((n, len(w)))
                dense[row[on], at[on]] = impact[on]
                total += (dense @ w).astype(np.int64)
            yield a, total


class Best:
    """The best documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.last = np.ones((items,), np.int64)               # a score below it cannot enter
        self.rows: dict[int, np.ndarray] = {}                 # per item tile: (item, score, no id, doc_id), ranked

    def add(self, a: int, score: np.ndarray, doc_id: np.ndarray, none: np.ndarray) -> None:
        docs, items = score.shape
        last = self.last[a:a + items]
        if docs > self.top:
            last = np.maximum(last, np.partition(score, docs - self.top, axis=0)[docs - self.top])
        d, i = np.nonzero(score >= last)
        if not len(d):
            return
        rows = np.stack([i, score[d, i], none[d], doc_id[d]])
        if a in self.rows:
            rows = np.concatenate([self.rows[a], rows], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], np.arange(items))
        place = np.arange(rows.shape[1]) - first[rows[0]]
        self.rows[a] = rows = rows[:, place < self.top]
        full = place[place < self.top] == self.top - 1
        self.last[a + rows[0, full]] = rows[1, full]


def _best_rows(rows: DataFrame, shared, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of each task."""
    def run(batches):
        ids, tiles = shared.value
        best = Best(len(ids), top)
        for batch in batches:
            for part in (batch.slice(x, DOC_TILE) for x in range(0, batch.num_rows, DOC_TILE)):
                slots = part.column("slots").to_pylist()
                slot = np.frombuffer(b"".join(slots), np.int32)
                tf = np.frombuffer(b"".join(part.column("counts").to_pylist()), np.int32).astype(np.int64)
                row = np.repeat(np.arange(len(slots)), [len(s) // 4 for s in slots])
                m = norms(part.column("n").to_numpy(), n_docs, n_terms)
                impact = (1_000_000_000 * tf // (1000 * tf + 8 * m[row])).astype(np.float64)
                none = part.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                doc_id = part.column("doc_id").fill_null(0).to_numpy()
                for a, score in tiles.scores(len(slots), row, slot, impact):
                    best.add(a, score, doc_id, none)
        for a, r in best.rows.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[a + i] for i in r[0]], pa.int64()), pa.array(r[3], mask=r[2] > 0), pa.array(r[1])],
                                             names=["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``top`` best documents of every item with a score above 0."""
    spark = docs.sparkSession
    pairs = written(item_terms(items), "lexical-items")
    n_blocks = max(1, -(-pairs.count() // block_terms))
    by_score = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    out = None
    for b in range(n_blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)
        block = Block([tuple(r) for r in mine.toLocalIterator()])             # about ``block_terms``, or one larger item
        shared = spark.sparkContext.broadcast(block)
        rows = postings(docs, shared)
        size = rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        n_docs, n_terms = size["docs"], max(1, size["terms"] or 0)
        weight = term_weights(frequencies(rows, len(block.slot)), n_docs)
        tiles = spark.sparkContext.broadcast((block.ids, Tiles(block, weight)))
        found = _best_rows(rows, tiles, n_docs, n_terms, top)
        part = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*by_score)
        found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*by_score))).where(F.col("rank") <= top)
        found = written(found.select("item_id", "rank", "doc_id", "score"), "lexical-best")
        out = found if out is None else out.unionByName(found)
        tiles.unpersist()
        shared.unpersist()
    return out
