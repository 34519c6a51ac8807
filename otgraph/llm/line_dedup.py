"""Line dedup by a deletion-neighbourhood join; the earliest of equal or nearly equal lines stays.

Lines are the ``\\n``-split parts of a text, compared after trimming blanks at their ends. Two
lines are linked when they are equal, or when both have ``MIN_FUZZY`` characters or more and lie
within one edit. A line goes when an earlier line (by doc_id, text hash, line number) is linked
with it; blank lines are left alone.

The join works on hashed keys in three steps:

1. *Block deletions*: with one of ``BLOCKS`` equal blocks deleted, lines within one edit of each
   other are equal for the block that holds the edit. Keys shared by different lines are found by
   a grouping that combines before its shuffle; a bitmap of them (fixed size, no false negatives) keeps all other lines from
   moving at all. No linked pair is lost.
2. *Narrowing*: the deleted block of the lines that share a key is cut into blocks in turn, again and again until it
   has ``LEAF`` characters, and only keys shared by different lines go on. Lines that differ in more than one place, or by
   a whole word, part here, so large groups of edited copies do not reach the last step.
3. *Character deletions*: inside the deleted block, the block itself and every variant with one
   character deleted are hashed. A line that equals another's variant lacks one character of it;
   two lines with the same variant at the same place differ by one substitution. Each key keeps
   only its earliest line, so no pairs within a group are listed, and the edit distance to that
   line is verified.

Defined results: null texts stay null and have no lines; repeated rows (same id, same text) are one
row with equal verdicts; null ids come first; a document all of whose non-blank lines went has an
empty text (``remove_lines`` drops it, as its content stands elsewhere); of lines with the same place in the order
none exist; extra columns of any name pass through ``remove_lines`` and are ignored elsewhere; empty tables give
empty tables. A very long line is hashed ten times over and moves only if it shares a key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.llm.common import mix, text_key, written

MIN_CHARS = 1        # characters of the lines that are compared
MIN_FUZZY = 24       # shorter lines are removed only when equal
BLOCKS = 3
LEAF = 8             # characters of a block that is not cut further
BITS = 26            # log2 of the bitmap's bits: 8 MB whatever the data's size
SEEN_LINES = 300_000  # lines a task remembers to skip repeats, before it starts afresh

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_FIRST = "struct<doc_id:bigint,_tk:bigint,line_no:int>"


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("text is not null").select("doc_id", text_key(F.col("text")).alias("_tk"), "text")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _lines(text: str):
    """(line number, trimmed line, 128-bit hash) of the lines that may be removed."""
    for i, line in enumerate(text.split("\n")):
        line = line.strip(" \t\r")
        if len(line) >= MIN_CHARS:
            yield i, line, xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, _tk, line_no, h, h2, n) of every line that may be removed."""
    def run(batches):
        for batch in batches:
            src, out = [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                for i, line, h in _lines(text):
                    src.append(k)
                    out.append((i, _signed(h & 0xFFFFFFFFFFFFFFFF), _signed(h >> 64), len(line)))
            cols = list(zip(*out)) or [()] * 4
            take = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), batch.column("_tk").take(take), pa.array(cols[0], pa.int32()),
                 pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32())],
                names=["doc_id", "_tk", "line_no", "h", "h2", "n"])

    return _texts(docs).mapInArrow(run, "doc_id long, _tk long, line_no int, h long, h2 long, n int")


def _first():
    return F.min(F.struct("doc_id", "_tk", "line_no")).alias("first")


def block_keys(line: str):
    """(key, start and end of the block) for every deleted block of a line."""
    n = len(line)
    for u in {n // BLOCKS, (n - 1) // BLOCKS}:
        for g in range(BLOCKS):
            a, b = g * u, n - (BLOCKS - 1 - g) * u
            rest = f"{u},{g},{line[:a]}\x00{line[b:]}"
            yield _signed(xxhash.xxh3_64_intdigest(rest.encode("utf-8", "surrogatepass"))), a, b


def _new_lines(texts, seen: set):
    """Lines long enough for the fuzzy join that the task has not met yet."""
    for text in texts:
        for _, line, h in _lines(text):
            if len(line) >= MIN_FUZZY and h not in seen:
                if len(seen) >= SEEN_LINES:
                    seen.clear()
                seen.add(h)
                yield line, _signed(h & 0xFFFFFFFFFFFFFFFF), _signed(h >> 64)


def shared_keys(docs: DataFrame) -> DataFrame:
    """Block keys of two or more different lines."""
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out = [(key, h) for line, h, _ in _new_lines(batch.column("text").to_pylist(), seen) for key, _, _ in block_keys(line)]
            cols = list(zip(*out)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "h"])

    keys = _texts(docs).select("text").mapInArrow(run, "key long, h long")
    return keys.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """Bits set at the keys' top ``BITS`` bits: at most 2^BITS / 8 bytes reach the driver."""
    at = F.shiftrightunsigned("key", 64 - BITS) + 1
    parts = keys.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    out = np.zeros(1 << BITS >> 3, np.uint8)
    for r in parts:
        m = np.frombuffer(bytes(r["m"]), np.uint8)
        start = (r["b"] - 1) * len(m)
        out[start:start + len(m)] = m[:len(out) - start]
    return out


def live_blocks(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, h, h2, n, mid) of the blocks whose key is shared by another line."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(shared))

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            out, bm = [], bits.value
            for line, h, h2 in _new_lines(batch.column("text").to_pylist(), seen):
                for key, a, b in block_keys(line):
                    at = (key & 0xFFFFFFFFFFFFFFFF) >> (64 - BITS)
                    if bm[at >> 3] >> (at & 7) & 1:
                        out.append((key, h, h2, len(line), line[a:b]))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
                names=["key", "h", "h2", "n", "mid"])

    rows = _texts(docs).select("text").mapInArrow(run, "key long, h long, h2 long, n int, mid string")
    return rows.join(shared, "key", "left_semi").dropDuplicates(["key", "h", "h2"])


def _cut_blocks(batches):
    """Live rows with longer blocks → a row for every deleted block of the block."""
    for batch in batches:
        out, src = [], []
        for i, (key, mid) in enumerate(zip(batch.column("key").to_pylist(), batch.column("mid").to_pylist())):
            for k, a, b in block_keys(mid):
                src.append(i)
                out.append((_signed(int(mix(np.array([(k ^ key * 0x9E3779B1) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])), mid[a:b]))
        take, cols = pa.array(src, pa.int64()), list(zip(*out)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[batch.column(c).take(take) for c in ("h", "h2", "n", "first")],
                                          pa.array(cols[1], pa.string())], names=["key", "h", "h2", "n", "first", "mid"])


def narrowed(live: DataFrame) -> DataFrame:
    """(key, h, h2, n, first, mid) with blocks of ``LEAF`` + 1 characters at most, whose key another line shares. Two
    blocks one edit apart differ by one character at most: at each step both are cut, or both are leaves."""
    leaves = []
    size = F.char_length("mid")
    while True:
        leaves.append(live.where(size <= LEAF + 1))
        longer = live.where(size > LEAF)
        if longer.isEmpty():
            break
        parts = longer.select("key", "h", "h2", "n", "first", "mid").mapInArrow(
            _cut_blocks, f"key long, h long, h2 long, n int, first {_FIRST}, mid string").dropDuplicates(["key", "h", "h2"])
        shared = parts.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
        live = written(parts.join(shared, "key", "left_semi"), "line-parts")
    out = leaves[0]
    for x in leaves[1:]:
        out = out.unionByName(x)
    return out


def deletion_keys(mid: str) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Hashes of all one-character deletions of ``mid``, by place; the places that give different
    variants (deletions inside a run of one character agree); and its own hash."""
    c = np.frombuffer(mid.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + _U(1)
    n = len(c)
    pw = np.cumprod(np.concatenate(([_U(1)], np.full(n, _BASE, np.uint64))))
    pre = np.concatenate(([_U(0)], np.cumsum(c * pw[:n])))         # sum of c[i] B^i
    whole = pre[n]
    # characters after place i move one place down: divide their part by B
    inv = _U(pow(_BASE, -1, 1 << 64))
    gone = pre[:n] + (whole - pre[1:]) * inv
    keep = np.ones(n, bool)
    keep[1:] = c[1:] != c[:-1]                       # a run gives the same variant: its first place
    at = np.flatnonzero(keep)
    return mix(gone + _U(n - 1)), at, mix(np.array([whole + _U(n)], np.uint64))[0]


def _variants(batches):
    """Live rows → (vkey, kind, first, key, h): hashed deletion keys. Kind 1: the block itself, for
    lines that meet longer ones; 0: its variants, for lines that meet shorter ones; 2: its variants by
    place, for lines that meet others of their length."""
    for batch in batches:
        keys, src, kinds = [], [], []
        key = batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
        wants = [batch.column(c).to_pylist() for c in ("longer", "shorter", "same")]
        for i, mid in enumerate(batch.column("mid").to_pylist()):
            k, at, own = deletion_keys(mid)
            here = mix(k ^ key[i])
            for kind, want, v in ((1, wants[0][i], mix(np.array([own ^ key[i]], np.uint64))), (0, wants[1][i], here[at]),
                                  (2, wants[2][i], mix(here + mix(np.arange(len(k), dtype=np.uint64) + _U(7))))):
                if want:
                    keys.append(v)
                    kinds.append(np.full(len(v), kind, np.int8))
                    src.append(np.full(len(v), i))
        if not src:
            continue
        take = pa.array(np.concatenate(src))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(kinds)), batch.column("key").take(take),
             batch.column("h").take(take), batch.column("first").take(take)], names=["vkey", "kind", "key", "h", "first"])


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(h, h2) of distinct lines with an earlier line one edit away. ``firsts``: (h, h2, first)."""
    live = live_blocks(docs, written(shared_keys(docs), "line-keys"))
    live = written(narrowed(written(live.join(firsts, ["h", "h2"]), "line-blocks")), "line-leaves")
    # which lengths meet under a key
    sizes = live.groupBy("key", "n").agg((F.min("h") != F.max("h")).alias("same"))
    longer = sizes.select("key", (F.col("n") - 1).alias("n"), F.lit(True).alias("longer"))
    shorter = sizes.select("key", (F.col("n") + 1).alias("n"), F.lit(True).alias("shorter"))
    meet = live.join(sizes, ["key", "n"]).join(longer, ["key", "n"], "left").join(shorter, ["key", "n"], "left")
    meet = meet.where("same or longer or shorter")
    var = meet.select("key", "h", "first", "mid", "longer", "shorter", "same").mapInArrow(
        _variants, f"vkey long, kind byte, key long, h long, first {_FIRST}")
    best = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("first", "h")))
    lead = var.groupBy("vkey", "key").agg(best(1).alias("own"), best(0).alias("lacks"), best(2).alias("subst"),
                                          F.count("*").alias("c")).where("c > 1").drop("c")
    # kind 1 rows look at kind 0 leaders and the other way round; kind 2 rows at kind 2 leaders
    to = F.when(F.col("kind") == 1, F.col("lacks")).when(F.col("kind") == 0, F.col("own")).otherwise(F.col("subst"))
    cand = var.join(lead, ["vkey", "key"]).withColumn("to", to).where("to is not null and to.h <> h and to.first < first")
    cand = cand.select("key", "h", F.col("to.h").alias("to_h")).distinct()
    # verify the edit distance inside the block (all else is equal by the block key)
    a = live.select("key", "h", "h2", F.col("mid").alias("mid_a"))
    b = live.select("key", F.col("h").alias("to_h"), F.col("mid").alias("mid_b"))
    ok = cand.join(a, ["key", "h"]).join(b, ["key", "to_h"]).where(F.expr("levenshtein(mid_a, mid_b, 1)") >= 0)
    return ok.select("h", "h2").distinct()


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, _tk, drop) for documents that lose lines: ``drop`` holds the line numbers."""
    lines = written(line_rows(docs).dropDuplicates(["doc_id", "_tk", "line_no"]), "lines")
    groups = lines.groupBy("h", "h2").agg(_first(), F.count("*").alias("c"))
    near = near_lines(docs, groups.select("h", "h2", "first")).withColumn("near", F.lit(True))
    # repeated lines: all but the first; nearly equal to an earlier line: all
    judged = written(groups.where("c > 1").select("h", "h2", "first").join(near, ["h", "h2"], "full"), "lines-judged")
    out = lines.select("doc_id", "_tk", "line_no", "h", "h2").join(judged, ["h", "h2"])
    out = out.where("near or struct(doc_id, _tk, line_no) <> first")
    return out.groupBy("doc_id", "_tk").agg(F.sort_array(F.collect_set("line_no")).alias("drop"))


def _joined(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_lx_drop``: the numbers of lines to remove (null: none)."""
    drop = duplicate_lines(docs).select(F.col("doc_id").alias("_lx_id"), F.col("_tk").alias("_lx_tk"), F.col("drop").alias("_lx_drop"))
    key = docs["doc_id"].cast("long").eqNullSafe(drop["_lx_id"]) & (text_key(docs["text"].cast("string")) == drop["_lx_tk"])
    return docs.join(drop, key, "left")


def _kept():
    return F.expr("array_join(transform(filter(transform(split(cast(text as string), '\\n', -1), (x, i) -> struct(x as x, i as i)), "
                  "s -> not array_contains(_lx_drop, s.i)), s -> s.x), '\\n')")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text (without the removed lines) for every document row."""
    j = _joined(docs.select("doc_id", "text"))
    return j.select(F.col("doc_id").cast("long").alias("doc_id"),
                    F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long").alias("n_lines"),
                    F.coalesce(F.size("_lx_drop"), F.lit(0)).cast("long").alias("n_removed"),
                    F.when(F.col("_lx_drop").isNull(), F.col("text")).otherwise(_kept()).alias("text"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """The documents with duplicate lines removed from ``text`` (``n_chars``, if there, follows);
    documents that lose all they had go. Other columns pass through."""
    j = _joined(docs).withColumn("_lx_text", F.when(F.col("_lx_drop").isNull(), F.col("text")).otherwise(_kept()))
    j = j.where("_lx_drop is null or trim(regexp_replace(_lx_text, '\\\\s+', '')) <> ''")
    cols = []
    for f in docs.schema.fields:
        if f.name == "text":
            cols.append(F.col("_lx_text").cast(f.dataType).alias("text"))
        elif f.name == "n_chars":
            cols.append(F.when(F.col("_lx_drop").isNull(), F.col("n_chars")).otherwise(F.char_length("_lx_text")).cast(f.dataType).alias("n_chars"))
        else:
            cols.append(docs[f.name])
    return j.select(*cols)
