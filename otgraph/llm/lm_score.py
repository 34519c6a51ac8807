"""Cross-entropy difference of two matched n-gram language models.

The target model is counted on the documents labelled good, the background model on all documents.
Both are interpolated word bigram models of the same order, smoothing and vocabulary. Every word and word
pair has a count of its own (keyed by 64 bits), so the tables grow with the data:

* rows are packed into units of ``UNIT_CHARS`` characters, written once;
* words and pairs that are frequent in a few sampled units (``HOT`` at most) are counted over all units,
  partial sums per task, and broadcast;
* of all others each unit sends one partial sum per distinct word or pair to one of the key ranges (their
  number follows the input); a range adds them up and answers each unit with the sums of the other units.

Counts cover every token of every document. A document's own tokens are taken out of a model before it scores
the document.

    p(w | h) = L * c(h, w) / c(h) + (1 - L) * (c(w) + A) / (N + A * V)

``V`` is the number of distinct words, at least ``WORD_IDS``. Per token the loss under the target minus the
loss under the background is averaged: the lower ``score``, the closer the document is to the target.

Defined results: null, empty and blank texts have no tokens and null scores; repeated rows count and
score once per row; null labels or ids mark no target; without targets all words are equally likely
to the target model; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.llm.common import Words, chunked, mix, shuffles_dropped, small_batches, written

WORD_IDS = 1 << 17                     # least size of the vocabulary
LAMBDA, ALPHA = 0.6, 0.5
UNIT_CHARS = 2_000_000                 # of the texts of a unit; a longer single text is its own
HASH_CHARS = 250_000                   # of the texts hashed at a time
RANGE_CHARS = 2_000_000                # of input per key range
HOT, SAMPLE_UNITS = 1 << 18, 16        # keys broadcast, units they are chosen from
ROWS_OUT = 250_000                     # rows of one Arrow batch of counts
PARTS_OUT = 16                         # key ranges of one Arrow batch of a unit's counts

_U = np.uint64
_COUNTS = ("n", "t", "hn", "ht")       # tokens of all and of target documents, and as history


class Tokens:
    """Keys of the tokens of some texts: ``keys`` (sorted, distinct) of words (odd) and pairs (even), and
    for every token its word's, history's and pair's place in them (the last two of tokens after the
    first of their text)."""

    def __init__(self, texts: list):
        hashes, docs, many = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in chunked(texts, HASH_CHARS):           # hashing holds some fifty bytes a character
            w = Words(texts[a:b])
            hashes.append(w.hash)
            docs.append(w.doc + a)
            many.append(w.per_doc)
        h, self.doc, self.n = np.concatenate(hashes), np.concatenate(docs).astype(np.int32), np.concatenate(many)
        self.after = np.flatnonzero(self.doc[1:] == self.doc[:-1]) + 1
        word = h | _U(1)
        pair = mix(h[self.after - 1] * _U(3) + h[self.after]) & ~_U(1)
        del hashes, docs, many
        both = np.concatenate((word, pair))
        del word, pair
        self.keys, at = np.unique(both, return_inverse=True)
        self.word, self.pair = at[:len(h)].astype(np.int32), at[len(h):].astype(np.int32)
        self.hist = self.word[self.after - 1]

    def counts(self, target: np.ndarray) -> np.ndarray:
        """One row of ``_COUNTS`` each, over all documents; ``target``: per text."""
        m, d = len(self.keys), self.doc[self.after]
        on, late = target[self.doc], target[d]
        out = np.zeros((len(_COUNTS), m), np.int64)
        for row, parts in zip(out, ((self.word, self.pair), (self.word[on], self.pair[late]), (self.hist,), (self.hist[late],))):
            for x in parts:
                row += np.bincount(x, minlength=m)
        return out


def _own(doc: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """How often each token's slot occurs in its own text."""
    _, at, count = np.unique(doc.astype(np.int64) << 32 | slot, return_inverse=True, return_counts=True)
    return count.astype(np.int32)[at]


def losses(t: Tokens, own: tuple, count: np.ndarray, hist: np.ndarray, n_tokens: int, n_words: int, leave: np.ndarray) -> np.ndarray:
    """-log2 p of every token; ``count``, ``hist``: of each key. ``leave`` (per text): 1 if the text is
    part of the counts."""
    out = leave[t.doc]
    total = n_tokens - (t.n * leave)[t.doc]
    p = (count[t.word] - own[0] * out + ALPHA) / (total + ALPHA * n_words)
    if len(t.after):
        o = out[t.after]
        h, c = hist[t.hist] - own[1] * o, count[t.pair] - own[2] * o
        p[t.after] = np.where(h > 0, LAMBDA * c / np.maximum(h, 1) + (1 - LAMBDA) * p[t.after], p[t.after])
    return -np.log2(p)


def _in(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[at] == keys, at


def _flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, the text compressed (``z``, of ``size`` bytes) and whether it is the target's."""
    def run(batches):
        for batch in batches:
            raw = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column("text").to_pylist()]
            z = [pa.compress(x, "zstd", asbytes=True) if x else b"" for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(z, pa.binary()), pa.array([len(x) for x in raw], pa.int64())],
                                             names=["doc_id", "z", "size"])
            del raw, z                                    # before the next batch is read
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, z binary, size long")
    ids = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("_t", F.lit(True))
    return rows.join(ids, "doc_id", "left").select("doc_id", "z", "size", F.coalesce("_t", F.lit(False)).alias("_t"))


def _units(rows: DataFrame) -> DataFrame:
    """(unit, chars, doc_id, t, size, z): texts of about ``UNIT_CHARS`` in a row, compressed together."""
    def run(batches):
        ids, on, texts, held = [], [], [], 0

        def unit():
            raw = b"".join(texts)
            z = pa.compress(raw, "zstd", asbytes=True) if raw else b""
            return pa.RecordBatch.from_arrays(
                [pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([on], pa.list_(pa.bool_())),
                 pa.array([[len(x) for x in texts]], pa.list_(pa.int64())), pa.array([z], pa.binary())], names=["chars", "doc_id", "t", "size", "z"])

        for batch in batches:
            for d, z, size, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "z", "size", "_t"))):
                if texts and (held + size > UNIT_CHARS or len(texts) >= UNIT_CHARS // 16):
                    yield unit()
                    ids, on, texts, held = [], [], [], 0
                ids.append(d)
                on.append(t)
                texts.append(pa.decompress(z, size, "zstd", asbytes=True) if size else b"")
                held += size
        if texts:
            yield unit()

    out = rows.mapInArrow(run, "chars long, doc_id array<long>, t array<boolean>, size array<long>, z binary")
    with shuffles_dropped(rows.sparkSession), small_batches(rows.sparkSession):
        return written(out.withColumn("unit", F.monotonically_increasing_id()), "lm-units")


def _read(unit: dict) -> tuple[Tokens, np.ndarray]:
    raw = pa.decompress(unit["z"], unit["chars"], "zstd", asbytes=True) if unit["chars"] else b""
    ends = np.cumsum([0, *unit["size"]]).tolist()
    return Tokens([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(ends, ends[1:])]), np.array(unit["t"], bool)


def _each(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            pa.default_memory_pool().release_unused()


def _packed(batches):
    """Each batch of counts as one row of its columns' bytes."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy().astype(np.int64).tobytes()], pa.binary()) for c in batch.columns], names=batch.schema.names)


def _collected(df: DataFrame) -> list[np.ndarray]:
    """Columns of at most ``HOT`` + 1 rows of numbers."""
    with shuffles_dropped(df.sparkSession), small_batches(df.sparkSession):
        parts = df.mapInArrow(_packed, ", ".join(f"{c} binary" for c in df.columns)).collect()
    return [np.frombuffer(b"".join(bytes(r[c]) for r in parts), np.int64) for c in df.columns]


def hot_keys(units: DataFrame) -> np.ndarray:
    """Sorted keys that most of the sampled units have, ``HOT`` at most. Any choice gives the same scores."""
    def run(batches):
        for unit in _each(batches):
            keys = _read(unit)[0].keys.view(np.int64)
            for a in range(0, len(keys), ROWS_OUT):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:a + ROWS_OUT])], names=["key"])

    some = units.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(SAMPLE_UNITS)
    seen = units.join(F.broadcast(some), "unit").select("chars", "t", "size", "z").mapInArrow(run, "key long").groupBy("key").count()
    keys, = _collected(seen.where("count > 1").orderBy(F.desc("count"), "key").limit(HOT).select("key"))
    return np.sort(keys.view(np.uint64))


def hot_counts(units: DataFrame, hot) -> DataFrame:
    """(slot, n, t, hn, ht) of the broadcast hot keys, and of all tokens as slot -1: every task sums its
    units, Spark sums the tasks."""
    def run(batches):
        table = hot.value
        sums = np.zeros((4, len(table) + 1), np.int64)
        for unit in _each(batches):
            t, on = _read(unit)
            hit, at = _in(t.keys, table)
            sums[:, at[hit]] += t.counts(on)[:, hit]
            sums[:2, -1] += [t.n.sum(), t.n[on].sum()]
        slot = np.flatnonzero(sums[0])
        for a in range(0, len(slot), ROWS_OUT):
            s = slot[a:a + ROWS_OUT]
            yield pa.RecordBatch.from_arrays([pa.array(np.where(s == len(table), -1, s)), *[pa.array(x[s]) for x in sums]], names=["slot", *_COUNTS])

    part = units.select("chars", "t", "size", "z").mapInArrow(run, "slot long, n long, t long, hn long, ht long")
    return part.groupBy("slot").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _cold(t: Tokens, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys that are not hot, and where each key range begins among them."""
    place = np.flatnonzero(~_in(t.keys, table)[0])
    starts = np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)
    return place, np.append(np.searchsorted(t.keys[place], starts), len(place))


def answers(units: DataFrame, hot, bits: int) -> DataFrame:
    """(unit, part, sums, words): for each key range of each unit, in the order of the unit's keys, the
    counts of all other units if there are any; and with unit -1 the number of distinct words."""
    def ask(batches):
        for unit in _each(batches):
            t, on = _read(unit)
            place, cut = _cold(t, hot.value, bits)
            keys, counts = t.keys[place], t.counts(on)[:, place].astype(np.int32)
            del t, place
            parts = np.flatnonzero(np.diff(cut))
            for p0 in range(0, len(parts), PARTS_OUT):
                some = parts[p0:p0 + PARTS_OUT]
                data = [keys[cut[p]:cut[p + 1]].tobytes() + counts[:, cut[p]:cut[p + 1]].tobytes() for p in some]
                yield pa.RecordBatch.from_arrays([pa.array([unit["unit"]] * len(some), pa.int64()), pa.array(some.astype(np.int64)), pa.array(data, pa.binary())],
                                                 names=["unit", "part", "data"])

    def add(table):
        data = [x.as_py() for x in table.column("data")]
        sizes = [len(x) // 24 for x in data]
        keys = np.concatenate([np.frombuffer(x, np.uint64, m) for x, m in zip(data, sizes)])
        counts = np.concatenate([np.frombuffer(x, np.int32, 4 * m, 8 * m).reshape(4, m) for x, m in zip(data, sizes)], axis=1)
        distinct, at = np.unique(keys, return_inverse=True)
        rest = np.stack([np.bincount(at, c, len(distinct)).astype(np.int64)[at] - c for c in counts])
        sums, units, end = [b""], [-1], 0
        for unit, m in zip(table.column("unit").to_pylist(), sizes):
            mine = rest[:, end:end + m]
            end += m
            if mine.any():
                sums.append((mine.astype(np.int32) if mine.max() < 1 << 31 else mine).tobytes())
                units.append(unit)
        words = [int((distinct & _U(1)).sum())] + [0] * (len(units) - 1)
        part = table.column("part")[0].as_py()
        return pa.table({"unit": pa.array(units, pa.int64()), "part": pa.array([part] * len(units), pa.int64()), "sums": pa.array(sums, pa.binary()),
                         "words": pa.array(words, pa.int64())})

    asked = units.select("unit", "chars", "t", "size", "z").mapInArrow(ask, "unit long, part long, data binary")
    with shuffles_dropped(units.sparkSession), small_batches(units.sparkSession):     # what was asked is the largest shuffle
        return written(asked.groupBy("part").applyInArrow(add, "unit long, part long, sums binary, words long"), "lm-sums")


def score_documents(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ce_target, ce_background (bits a token) and score, their difference.
    ``target`` holds the ids (``doc_id``) of the target's documents."""
    share = docs.sparkSession.sparkContext.broadcast
    units = _units(_flagged(docs, target))
    chars = units.agg(F.sum("chars")).first()[0] or 0
    bits = max(4, (chars // RANGE_CHARS).bit_length())
    hot = hot_keys(units)
    shared = share(hot)
    slot, *sums = _collected(hot_counts(units, shared))
    table, sizes = np.zeros((4, len(hot)), np.int64), [int(x[slot < 0].sum()) for x in sums[:2]]
    table[:, slot[slot >= 0]] = [x[slot >= 0] for x in sums]
    rest = answers(units, shared, bits)
    n_words = max(WORD_IDS, int((hot & _U(1)).sum()) + (rest.agg(F.sum("words")).first()[0] or 0))
    totals = share(table)

    def run(left, right):
        ids, n, ce = [], [], []
        for unit in _each(left.to_batches()):
            t, on = _read(unit)
            count = t.counts(on)
            hit, at = _in(t.keys, shared.value)
            count[:, hit] = totals.value[:, at[hit]]
            place, cut = _cold(t, shared.value, bits)
            for p, x in zip(right.column("part").to_pylist(), right.column("sums")):
                mine = place[cut[p]:cut[p + 1]]
                x = x.as_py()
                count[:, mine] += np.frombuffer(x, np.int32 if len(x) == 16 * len(mine) else np.int64).reshape(4, len(mine))
            d = t.doc[t.after]
            own = _own(t.doc, t.word), _own(d, t.hist), _own(d, t.pair)
            both = [losses(t, own, count[1], count[3], sizes[1], n_words, on.astype(np.int64)),
                    losses(t, own, count[0], count[2], sizes[0], n_words, np.ones(len(on), np.int64))]
            ids += unit["doc_id"]
            n.append(t.n)
            ce.append(np.stack([np.bincount(t.doc, x, minlength=len(on)) for x in both]) / np.maximum(t.n, 1))
        n = np.concatenate([np.zeros(0, np.int64), *n]).astype(np.int64)
        ce = np.concatenate([np.zeros((2, 0)), *ce], axis=1)
        return pa.table([pa.array(ids, pa.int64()), pa.array(n), *[pa.array(x, mask=n == 0) for x in (ce[0], ce[1], ce[0] - ce[1])]],
                        names=["doc_id", "n_tokens", "ce_target", "ce_background", "score"])

    asked = units.groupBy("unit").cogroup(rest.where("unit >= 0").groupBy("unit"))
    return asked.applyInArrow(run, "doc_id long, n_tokens long, ce_target double, ce_background double, score double")
