"""Mixing sources to target weights: equal-token blocks by Sainte-Laguë apportionment, then seeded selection.

1. Every document's words are counted once; source and shard totals are summed. A source's documents are dealt to
   shards by a seeded hash (``SHARD_ROWS`` rows each, ``SHARDS`` shards of a source at most, so a hot source is
   many tasks' work).
2. Sources in code point order, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` of all words; a target above
   ``REPEAT`` times its source stops there and the excess is reshared by weight.
3. The words of the mix are blocks of one size, ``BLOCK_WORDS`` at most and small enough that the least target has
   ``BLOCKS_LEAST``. Blocks go to the sources, then a source's blocks to its shards, by the highest
   quotients target / (2 * blocks + 1); ties go to the first. No shard gets more than ``REPEAT`` times its blocks.
4. In a shard the documents stand in seeded order and are cut into blocks. A quota of q of n blocks takes all
   blocks q div n times, and q mod n of them once more: every (n / (q mod n))-th, from a seeded phase. How
   many of the first i blocks are chosen is a quotient, so a document's words are counted from its place, without a row per
   block.

Defined results: null, empty and blank texts have size 0 and nothing is taken of them; a null source is a
source of its own; a null doc_id is kept; rows repeated are documents of their own (equal rows may be taken
unequally often, but their rows as a set are the same in every run); a table without words has targets of 0; an empty
table gives no rows; extra columns of any name are ignored. Very long texts are counted in one pass over
their bytes. The driver holds one row per source and shard.
"""

from __future__ import annotations

import hashlib
import heapq
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from otgraph.llm.common import chunked, written

WEIGHTS, SHARE, REPEAT = (3, 1, 2), Fraction(3, 2), 2
BLOCK_WORDS, BLOCKS_LEAST = 64, 512
SHARD_ROWS, SHARDS = 2000, 4096
SEED = "mix"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True


def count_words(raws: list[bytes]) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text."""
    buf = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    word = ~_SEPARATOR[buf]
    starts = np.concatenate(([0], np.cumsum(word[1:] & ~word[:-1])))       # word starts at or before each byte
    edge = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return np.diff(starts[edge])


def sized(docs: DataFrame, text: bool = False) -> DataFrame:
    """doc_id, source, size and seeded hash of every row, and its text if asked for."""
    def run(batches):
        for batch in batches:
            raws = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            n = [count_words(raws[a:b]) for a, b in chunked(raws)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.concatenate([np.zeros(0, np.int64), *n]))],
                                             names=[*names, "size"])

    names = ["doc_id", "source", "text"] if text else ["doc_id", "source"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in (("doc_id", "long"), ("source", "string"), ("text", "string"), ("size", "long")) if c in [*names, "size"]))
    return rows.withColumn("h", F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size"))))


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: Fraction = SHARE, repeat: int = REPEAT) -> list[Fraction]:
    """Exact target of each source, in order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, heavy = share * sum(sizes), sum(w)
    out = [Fraction(0)] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: Fraction(repeat * sizes[i], w[i]))
    for k, i in enumerate(order):                                           # least room per weight first
        if repeat * sizes[i] * heavy >= left * w[i]:
            for j in order[k:]:
                out[j] = left * w[j] / heavy
            break
        out[i] = Fraction(repeat * sizes[i])
        left -= out[i]
        heavy -= w[i]
    return out


def sainte_lague(claims: list, seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients claim / (2 * seats so far + 1), ties to the first party; ``most``: a
    party's seats at most. All seats are given as long as a party with a claim has room."""
    claims = [Fraction(c) for c in claims]
    room = most or [seats] * len(claims)
    spare = 2 * seats - len(claims)
    got = [0] * len(claims)
    if spare > 0 and any(claims):
        bar = sum(claims) / spare           # at this quotient no more than all seats are given
        got = [min(int((c / bar + 1) / 2), m) for c, m in zip(claims, room)]
    heap = [(-c / (2 * g + 1), i) for i, (c, g) in enumerate(zip(claims, got)) if c and g < room[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < room[i]:
            heapq.heappush(heap, (-claims[i] / (2 * got[i] + 1), i))
    return got


def block_words(goals: list[Fraction], at_most: int = BLOCK_WORDS) -> int:
    """Words of a block: the least positive target has ``BLOCKS_LEAST`` blocks if it has so many words."""
    least = min((g for g in goals if g), default=Fraction(0))
    return max(1, min(at_most, int(least / BLOCKS_LEAST)))


def quotas(cells: list[tuple], block: int, goals: dict, repeat: int = REPEAT) -> list[tuple]:
    """(source, shard, blocks, quota, phase) of the cells (source, shard, size)."""
    names = list(goals)
    by: dict = {s: [] for s in names}
    for s, shard, size in sorted(cells, key=lambda c: c[1]):
        by[s].append((shard, size, -(-size // block)))
    seats = int(sum(goals.values()) / block + Fraction(1, 2))
    given = sainte_lague([goals[s] for s in names], seats, [repeat * sum(c[2] for c in by[s]) for s in names])
    out = []
    for s, q in zip(names, given):
        part = sainte_lague([c[1] for c in by[s]], q, [repeat * c[2] for c in by[s]])
        for (shard, _, n), got in zip(by[s], part):
            h = hashlib.md5(f"{SEED}:{shard}:{s if s is not None else ''}".encode()).hexdigest()
            out.append((s, shard, max(n, 1), got, int(h[:8], 16) % max(n, 1)))
    return out


def placed(docs: DataFrame, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, text: bool = False) -> DataFrame:
    """The mix: of every document row doc_id, source, size, source_size and target of its source, and its place: ``first``
    (words before it in its shard), ``block`` (words of one), ``n_blocks``, ``quota`` and ``phase`` of the shard."""
    spark = docs.sparkSession
    rows = written(sized(docs, text), "mix-sizes")
    found = rows.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()      # a row per source
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))                             # str: by code point
    goals = dict(zip((r["source"] for r in found), targets([r["size"] for r in found])))
    block = block_words(list(goals.values()), block)
    plan = spark.createDataFrame([(r["source"], min(SHARDS, -(-r["rows"] // shard_rows)), r["size"], float(goals[r["source"]])) for r in found],
                                 "_s string, n_shards long, source_size long, target double")
    rows = (rows.join(written(plan, "mix-sources"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
            .withColumn("shard", F.expr("cast(conv(substr(h, 1, 8), 16, 10) as bigint) % n_shards")).drop("n_shards"))
    cells = [tuple(r) for r in rows.groupBy("source", "shard").agg(F.sum("size")).collect()]                   # a row per shard
    cut = spark.createDataFrame(quotas(cells, block, goals), "_s string, _n long, n_blocks long, quota long, phase long")
    rows = rows.join(written(cut, "mix-quotas"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_n"))).drop("_s", "_n")
    before = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("first", F.sum("size").over(before) - F.col("size")).withColumn("block", F.lit(block).cast("long")).drop("h")


def mix(docs: DataFrame, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, size, source, source_size, target of its source, and taken (words of it in the mix, repeats counted)."""
    more = "((({i}) * (quota % n_blocks) + phase) div n_blocks)"                     # of the first i blocks, taken once more
    upto = "(block * {a} + ({x}) % block * ({b} - {a}))"                             # of the first x words
    words = [upto.format(x=x, a=more.format(i=f"({x}) div block"), b=more.format(i=f"({x}) div block + 1")) for x in ("first + size", "first")]
    return placed(docs, block, shard_rows).select(
        "doc_id", "size", "source", "source_size", "target", F.expr(f"(quota div n_blocks) * size + {words[0]} - {words[1]}").alias("taken"))


def mixed_texts(docs: DataFrame, block: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The mix itself: doc_id, source, pass (from 0), first word and text of every stretch of words that a pass takes."""
    names = ["doc_id", "source", "pass", "word", "text"]

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for r in part.to_pylist():
                    words = (r["text"] or "").encode().split()
                    i = (r["first"] + np.arange(r["size"])) // r["block"]
                    more = lambda x: (x * (r["quota"] % r["n_blocks"]) + r["phase"]) // r["n_blocks"]
                    times = r["quota"] // r["n_blocks"] + more(i + 1) - more(i)
                    for k in range(REPEAT):
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], times > k, [False]))))
                        out += [(r["doc_id"], r["source"], k, a, b" ".join(words[a:b]).decode()) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(kinds)], names=names)

    return placed(docs, block, shard_rows, text=True).mapInArrow(run, "doc_id long, source string, pass long, word long, text string")
