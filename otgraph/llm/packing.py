"""Best-fit packing by length patterns and non-negative least squares.

Documents become token pieces of at most ``size`` tokens; only longer documents are cut. The piece
lengths' histogram (at most ``size`` counts) is what the plan is made of:

1. enumerate patterns of up to three lengths that fill a sequence exactly;
2. fit repeat counts to the histogram by non-negative least squares (active sets, columns
   added in groups, dense algebra only over the active patterns);
3. round the counts, within the pieces that are there;
4. pack what is left best-fit, longest first, on the histogram (equal lengths together).

The plan is a table of slots: the r-th piece of a length has a fixed sequence and offset. Pieces get
their rank within a length from salted counts, so a length that holds a third of all rows is
numbered by many tasks, and look up their slot in the broadcast plan (bounded by the sequence
size, not by the data).

Token ids are those of the byte-level BPE file of ``tokenizers``; the same vocabulary as ranks is
read with tiktoken (tests compare the ids).

Defined results: null and empty texts are one piece of the end token; repeated rows are packed
once per row; null ids are packed like others; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otgraph.llm.common import text_key, written

SIZE = 1024
END_ID = 2
RANKS = "byte_bpe_50k.tiktoken"     # the vocabulary of byte_bpe_50k.json as ranks
WEIGHT_POWER = 1.0                  # of a length in the fit
RANK_ROWS = 50_000                  # rows numbered by one task, on average


class Encoder:
    """Text → token ids (bytes of little-endian uint32). The library splits and encodes a text in one pass over it
    with its own Unicode tables, which agree with the tokenizer's."""

    def __init__(self, ranks: str = RANKS):
        import public_tokenizers as P
        import tiktoken
        path = ranks if "/" in ranks else P.path(ranks)
        with open(path, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("corpus", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str | None) -> bytes:
        return array("I", self.bpe.encode_ordinary(text)).tobytes() if text else b""


_ENCODERS: dict[str, Encoder] = {}


def pieces_of(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document's ids with the end token."""
    ids += END_ID.to_bytes(4, "little")
    n = len(ids) // 4
    first = n if n <= size else (n % size or size)
    cuts = [0, *range(first, n + 1, size)]
    view = memoryview(ids)
    return [(a, b - a, zlib.crc32(view[4 * a:4 * b])) for a, b in zip(cuts, cuts[1:])]


def token_pieces(docs: DataFrame, size: int = SIZE, ranks: str = RANKS) -> DataFrame:
    """(doc_id, _tk, piece, start, length, ids_crc32) of every document row."""
    def run(batches):
        enc = _ENCODERS.get(ranks) or _ENCODERS.setdefault(ranks, Encoder(ranks))
        for batch in batches:
            src, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                got = pieces_of(enc.encode(text), size)
                src += [i] * len(got)
                rows += [(k, *p) for k, p in enumerate(got)]
            take = pa.array(src, pa.int64())
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("_tk").take(take), pa.array(cols[0], pa.int32())]
                + [pa.array(c, pa.int64()) for c in cols[1:]], names=["doc_id", "_tk", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", text_key(F.col("text")).alias("_tk"), "text")
    return rows.mapInArrow(run, "doc_id long, _tk long, piece int, start long, length long, ids_crc32 long")


# ---- the plan -------------------------------------------------------------------------------
def exact_patterns(count: np.ndarray, size: int) -> np.ndarray:
    """All patterns of one to three present lengths that sum to ``size``, as rows of three (0:
    none), longest first."""
    have = np.flatnonzero(count)
    there = np.zeros(size + 1, bool)
    there[have] = True
    out = [np.array([[size, 0, 0]])] if there[size] else []
    pair = have[(have < size) & (2 * have >= size)]
    pair = pair[there[size - pair]]
    out.append(np.stack([pair, size - pair, 0 * pair], 1))
    for a in have[have < size]:
        b = have[(have <= a) & (2 * have >= size - a) & (have < size - a)]
        b = b[there[size - a - b]]
        out.append(np.stack([np.full_like(b, a), b, size - a - b], 1))
    return np.vstack(out).astype(np.int64)


def nnls(count: np.ndarray, pats: np.ndarray, rounds: int = 40, group: int = 160) -> np.ndarray:
    """Repeat counts x >= 0 with least squares error of the pattern columns against ``count``. The
    error of a length weighs as a power of it: short pieces left over fit in anywhere later."""
    weight = (np.arange(len(count)) / (len(count) - 1)) ** WEIGHT_POWER
    x, on = np.zeros(len(pats)), np.zeros(len(pats), bool)
    best, best_x, stale = np.inf, x, 0
    target = count * weight

    def columns(idx):
        m = np.zeros((len(target), len(idx)))
        for k in range(3):
            m[pats[idx, k], np.arange(len(idx))] += weight[pats[idx, k]]
        m[0] = 0
        return m

    for _ in range(rounds):
        idx = np.flatnonzero(on)
        resid = target - (columns(idx) @ x[idx] if len(idx) else 0)
        resid[0] = 0
        err = float(resid @ resid)
        stale = stale + 1 if err > 0.999 * best else 0
        if err < best:
            best, best_x = err, x.copy()
        if stale >= 5 or best < 1e-3:
            break
        grad = (resid * weight)[pats].sum(axis=1)
        grad[on] = -1
        order = np.argsort(-grad)[:40 * group]
        used, new = set(), []
        for j in order:                              # a group of columns that do not compete
            if grad[j] <= 1e-4 or len(new) == group:
                break
            if not used & {*pats[j].tolist()} - {0}:
                new.append(j)
                used |= {*pats[j].tolist()} - {0}
        if not new:
            break
        on[new] = True
        for _ in range(5):
            idx = np.flatnonzero(on)
            m = columns(idx)
            s = np.linalg.solve(m.T @ m + 1e-6 * np.eye(len(idx)), m.T @ target)
            if (s > 0).all():
                break
            on[idx[s <= 0]] = False
        x = np.zeros(len(pats))
        x[idx] = np.maximum(s, 0)
        on = x > 0
    return best_x


def best_fit(count: np.ndarray, size: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Pack a histogram longest first into the tightest open sequences, equal ones together.
    Returns ([(length, times), ...], sequences)."""
    open_: dict[int, list] = defaultdict(list)       # space left → [[pattern, sequences]]

    def put(pattern, space, many, length, times):
        if many:
            open_[space - length * times].append([[*pattern, (length, times)], many])

    for length in np.flatnonzero(count)[::-1]:
        length, n = int(length), int(count[length])
        for space in sorted(s for s in open_ if s >= length):
            k = space // length
            while n and open_[space]:
                pattern, many = open_[space].pop()
                full = min(many, n // k)
                put(pattern, space, full, length, k)
                n -= full * k
                many -= full
                if many and 0 < n < k:
                    put(pattern, space, 1, length, n)
                    many, n = many - 1, 0
                if many:
                    open_[space].append([pattern, many])
            if not open_[space]:
                del open_[space]
            if not n:
                break
        if n:
            k = size // length
            put([], size, n // k, length, k)
            if n % k:
                put([], size, 1, length, n % k)
    return [(p, m) for groups in open_.values() for p, m in groups if m]


def plan(count: np.ndarray, size: int = SIZE) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern as (length, times) pairs, number of sequences)] that place every piece."""
    left = count.astype(np.int64).copy()
    out = []
    pats = exact_patterns(left, size)
    if len(pats):
        x = nnls(left, pats)
        for share in (1.0, 0.5):                     # whole repeats first, then rounded-up ones
            for j in np.argsort(-x):
                want = int(x[j]) if share == 1.0 else int(x[j] - int(x[j]) >= share)
                if x[j] < share:
                    break
                lens, times = np.unique(pats[j][pats[j] > 0], return_counts=True)
                many = min(want, int((left[lens] // times).min()))
                if many > 0:
                    left[lens] -= many * times
                    out.append(([(int(a), int(b)) for a, b in zip(lens, times)], many))
    return out + best_fit(left, size)


def slots(planned: list, size: int = SIZE) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length sorted arrays (first rank, times, first sequence, first offset)."""
    rows, rank, seq = defaultdict(list), defaultdict(int), 0
    for pattern, many in planned:
        offset = 0
        for length, times in pattern:
            rows[length].append((rank[length], times, seq, offset))
            rank[length] += times * many
            offset += times * length
        seq += many
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in rows.items()}


def pack(docs: DataFrame, size: int = SIZE, ranks: str = RANKS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, size, ranks), "pieces")
    count = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():          # at most ``size`` rows
        count[r["length"]] = r["count"]
    table = spark.sparkContext.broadcast(slots(plan(count, size), size))
    salts = int(1 + count.sum() // RANK_ROWS)
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "_tk", "piece"), F.lit(salts)))
    per = rows.groupBy("length", "_salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    rn = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "_tk", "piece"))
    ranked = rows.withColumn("_rn", rn).join(per, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rn") - 1).alias("_rank"))

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(part):
                    continue
                n = int(length[part[0]])
                first, times, s, o = table.value[n]
                at = np.searchsorted(first, rank[part], side="right") - 1
                nth = rank[part] - first[at]
                seq[part] = s[at] + nth // times[at]
                off[part] = o[at] + nth % times[at] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
