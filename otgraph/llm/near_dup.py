"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming join.

A document's set holds its distinct word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z lowered; with
fewer words than a shingle, the whole sequence as one; without words, empty). Documents whose sets
have Jaccard similarity of at least ``num/den`` are linked; components follow links.

* Documents with equal sets form a class first (equal sets are always linked), so copies never
  meet in the join: only class representatives go on.
* A signature has ``CHUNKS * SLOTS`` slots of ``BITS`` bits, split into ``CHUNKS`` chunks. Two
  signatures that differ in at most ``RADIUS`` = 2 * CHUNKS - 1 slots have, by the pigeonhole
  principle, a chunk with at most one differing slot. Every chunk is entered once per allowed error,
  with that slot masked, so all pairs within the radius share a key. At similarity 0.85 a slot differs
  with probability 0.15; more than 15 of 40 differ with probability 1.5e-4.
* In a bucket (documents of one key) each member is paired with the bucket's first one and verified
  on the full sets. Buckets that then still hold different components are searched
  completely, of buckets with the same members the first. The rows of a sorted partition are whole buckets; one of over
  ``BLOCK`` members comes as pairs of blocks of that many. Members of different components within the radius
  are candidates if a second signature of ``FINE`` one-byte slots also lets them reach the similarity (all but
  3e-6 of true links do), each pair in the first of its common buckets only. Members with a candidate are given
  their full sets and searched once more, in blocks of about ``BLOCK_VALUES`` shingles: candidates not yet joined
  are verified there, the most similar first, and only links that join two components leave the
  task. So no link between components is lost, and the pairs of a group, linked or not, are never rows.
* Components: smallest label over links, with pointer jumping, from written tables.

Defined results: null and empty texts (and texts of blanks) have an empty set, are linked with nothing and
kept; repeated rows form one class; null ids come last and are a component's id only among
null ids; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from otgraph.llm.common import Words, chunked, mix, small_batches, text_key, written

CHUNKS, SLOTS, BITS = 8, 5, 16
RADIUS = 2 * CHUNKS - 1
BLOCK = 4096                           # members of a bucket searched together
BLOCK_VALUES = 1 << 20                 # shingles of members verified together
FINE = 512

_U = np.uint64
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 63, CHUNKS * SLOTS, dtype=np.uint64) * _U(2) + _U(1)
_B = _RNG.integers(0, 1 << 63, CHUNKS * SLOTS, dtype=np.uint64)
_FA = _RNG.integers(1, 1 << 63, FINE, dtype=np.uint64) * _U(2) + _U(1)
_FB = _RNG.integers(0, 1 << 63, FINE, dtype=np.uint64)


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes."""
    out: list[np.ndarray] = []
    for a, b in chunked(texts):
        w = Words(texts[a:b])
        h, at = w.windows(k)
        cut = np.searchsorted(at, w.first)
        for i in range(b - a):
            n = w.per_doc[i]
            if n >= k:
                out.append(np.unique(h[cut[i]:cut[i + 1]]))
            elif n:
                s = np.full(1, n, np.uint64)
                for x in w.hash[w.first[i]:w.first[i + 1]]:
                    s = mix(s + x)
                out.append(mix(s + _U(0x51)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        low = np.minimum(low, (s[None, i:i + 4096] * a[:, None] + b[:, None]).min(axis=1))
    return mix(low)


def signature(s: np.ndarray) -> np.ndarray:
    return (_minima(s, _A, _B) & _U((1 << BITS) - 1)).astype(np.uint16)


def fine_signature(s: np.ndarray) -> np.ndarray:
    return (_minima(s, _FA, _FB) & _U(255)).astype(np.uint8)


def fine_limit(num: int, den: int) -> int:
    """Differing fine slots that pairs of the least similarity stay under, by 4.5 deviations."""
    p = (1 - num / den) * 255 / 256
    return int(FINE * p + 4.5 * (FINE * p * (1 - p)) ** 0.5 + 1)


def masked_keys(sigs: np.ndarray) -> np.ndarray:
    """Keys of each row's signature, one per (chunk, allowed error): the chunk's other slots."""
    c = sigs.reshape(-1, CHUNKS, SLOTS).astype(np.uint64)
    out = np.empty((len(c), CHUNKS * SLOTS), np.uint64)
    for j in range(SLOTS):
        h = np.broadcast_to(np.arange(CHUNKS, dtype=np.uint64) * _U(SLOTS) + _U(j + 1), c.shape[:2])
        for i in range(SLOTS):
            if i != j:
                h = mix(h) + c[:, :, i]
        out[:, j::SLOTS] = mix(h)
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, _tk, n, s1, s2, sig): set size, digest of the set, packed signature."""
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            s1 = np.array([np.add.reduce(s) if len(s) else 0 for s in sets], np.uint64)
            s2 = np.array([np.bitwise_xor.reduce(mix(s * _U(3))) if len(s) else 0 for s in sets], np.uint64)
            sig = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_tk"), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sig, pa.binary())],
                names=["doc_id", "_tk", "n", "s1", "s2", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", text_key(F.col("text")).alias("_tk"), "text")
    return rows.mapInArrow(run, "doc_id long, _tk long, n long, s1 long, s2 long, sig binary")


def bucket_rows(reps: DataFrame) -> DataFrame:
    """(key, place, rep) for every masked chunk, numbered, of every representative."""
    def run(batches):
        for batch in batches:
            sigs = batch.column("sig").to_pylist()
            if not sigs:
                continue
            keys = masked_keys(np.frombuffer(b"".join(sigs), np.uint16)).ravel()
            take = pa.array(np.repeat(np.arange(len(sigs)), CHUNKS * SLOTS))
            place = pa.array(np.tile(np.arange(CHUNKS * SLOTS, dtype=np.int8), len(sigs)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), place, batch.column("rep").take(take)], names=["key", "place", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "key long, place byte, rep long")


def _texts_of(need: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of some representatives."""
    which = reps.join(need, "rep").select("rep", F.col("doc_id").alias("_id"), F.col("_tk").alias("_t"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_tk", text_key(F.col("text")))
    return rows.join(which, rows["doc_id"].eqNullSafe(which["_id"]) & (rows["_tk"] == which["_t"])).select("rep", "text")


def sets_of(members: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rep, s): the full sets of some representatives, shingled once and written."""
    def run(batches):
        for batch in batches:
            out = [s.view(np.int64) for s in shingle_sets(batch.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(out, pa.list_(pa.int64()))], names=["rep", "s"])

    rows = _texts_of(members, reps, docs).mapInArrow(run, "rep long, s array<long>")
    return written(rows.dropDuplicates(["rep"]), "nd-sets")                     # repeated rows count once


def fine_signatures(sets: DataFrame) -> DataFrame:
    """(rep, sig, fine, size) of (rep, s)."""
    def run(batches):
        for batch in batches:
            sets = [np.asarray(x.values.to_numpy()).view(np.uint64) for x in batch.column("s")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array([signature(s).tobytes() for s in sets], pa.binary()), pa.array([fine_signature(s).tobytes() for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64())], names=["rep", "sig", "fine", "size"])

    return written(sets.select("rep", "s").mapInArrow(run, "rep long, sig binary, fine binary, size long"), "nd-fine")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of representatives whose full sets reach the similarity."""
    j = (pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
         .join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    union = F.size("sa") + F.size("sb") - both
    return j.where(both * den >= union * num).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) with the smallest node reachable over ``edges`` (a, b); nodes without
    edges are left out."""
    both = written(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "nd-edges")
    label = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "nd-label")
    while True:
        # smallest label of the neighbours, then of the label's own node
        near = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("comp").alias("near"))
        step = label.join(near, label["node"] == near["a"], "left").select(
            "node", F.col("comp").alias("old"), F.least("comp", F.coalesce("near", "comp")).alias("mid"))
        up = label.select(F.col("node").alias("mid"), F.col("comp").alias("up"))
        new = written(step.join(up, "mid", "left").select("node", F.least("mid", F.coalesce("up", "mid")).alias("comp"),
                                                          F.col("old")), "nd-label")
        changed = new.where("comp <> old").limit(1).count()
        label = new.select("node", "comp")
        if not changed:
            return label


class _Members:
    """Rows of buckets as arrays; ``keys``: their masked keys, ``group``: key and pair of blocks."""

    def __init__(self, table: pa.Table):
        col = {c: table.column(c).to_numpy() for c in ("key", "i", "j", "blk", "rep", "comp", "size")}
        self.blk, self.rep, self.comp, self.size = (col[c] for c in ("blk", "rep", "comp", "size"))
        self.group = np.stack([col["key"], col["i"].astype(np.int64), col["j"].astype(np.int64)], axis=1)
        n = table.num_rows
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(n, -1)
        self.fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(n, -1)
        self.keys = masked_keys(self.sig)
        self.sets = [x.values.to_numpy().view(np.uint64) for x in table.column("s")] if "s" in table.column_names else []

    def groups(self):
        edge = np.flatnonzero(np.concatenate(([True], (self.group[1:] != self.group[:-1]).any(axis=1), [True])))
        return zip(edge.tolist(), edge[1:].tolist())

    def candidates(self, x: int, y: int, limit: int):
        """(row, rows) of the group in rows [x, y): of different components, within the radius and the fine limit (the most
        similar first), in the first bucket they share."""
        key, i, j = self.group[x]
        here, rows = np.array([key], np.int64).view(np.uint64)[0], np.arange(x, y)
        left, right = rows[self.blk[x:y] == i], rows[self.blk[x:y] == j]
        for nth, a in enumerate(left):
            b = right[nth + 1:] if i == j else right
            b = b[self.comp[b] != self.comp[a]]
            if len(b):
                b = b[(self.sig[b] != self.sig[a]).sum(axis=1) <= RADIUS]
            if len(b):
                b = b[self.keys[a][np.argmax(self.keys[b] == self.keys[a], axis=1)] == here]
            if len(b):
                d = (self.fine[b] != self.fine[a]).sum(axis=1)
                b = b[np.argsort(d, kind="stable")][:int((d <= limit).sum())]
            if len(b):
                yield int(a), b


def _groups(search):
    """``search`` over the groups of rows that follow one another in a sorted partition."""
    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            same = np.logical_and.reduce([(x := batch.column(c).to_numpy()) == x[-1] for c in ("key", "i", "j")])
            cut = int((~same).sum())
            if cut:                                       # the last group may go on in the next batch
                held[-1] = batch.slice(0, cut)
                yield search(_Members(pa.Table.from_batches(held)))
                held = [batch.slice(cut)]
        if held:
            yield search(_Members(pa.Table.from_batches(held)))

    return run


def _promising(limit: int):
    """(key, rep, comp, size) of the members with a candidate."""
    def search(m: _Members) -> pa.RecordBatch:
        found = np.zeros(len(m.rep), bool)
        for x, y in m.groups():
            for a, b in m.candidates(x, y, limit):
                found[a] = found[b] = True
        return pa.RecordBatch.from_arrays([pa.array(c[found]) for c in (m.group[:, 0], m.rep, m.comp, m.size)], names=["key", "rep", "comp", "size"])

    return _groups(search)


def _joining(limit: int, num: int, den: int):
    """Links (a, b), verified on the full sets, that join two components of a group."""
    def search(m: _Members) -> pa.RecordBatch:
        links = []
        for x, y in m.groups():
            root: dict = {}

            def find(c):
                while root.get(c, c) != c:
                    root[c] = root.get(root[c], root[c])
                    c = root[c]
                return c

            for a, rows in m.candidates(x, y, limit):
                for b in rows.tolist():
                    ca, cb = find(int(m.comp[a])), find(int(m.comp[b]))
                    if ca != cb and similar(m.sets[a], m.sets[b], num, den):
                        root[ca] = cb
                        links.append(sorted((int(m.rep[a]), int(m.rep[b]))))
        p = np.array(links, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

    return _groups(search)


def similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both * den >= (len(a) + len(b) - both) * num


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    """Members of a bucket by pairs (i, j) of its blocks; nearly all have one block. One row per block of the bucket."""
    rows = rows.withColumn("nb", blocks).withColumn("blk", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("nb")))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, nb - 1)")))
    rows = rows.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other")).drop("nb", "other")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def open_links(left: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Verified links that join the components among the members (key, rep, comp, c) of open buckets."""
    limit, spark = fine_limit(num, den), left.sparkSession
    fine = fine_signatures(sets.join(left.select("rep").distinct(), "rep", "left_semi"))
    rows = _dealt(left.join(fine, "rep"), F.ceil(F.col("c") / BLOCK))
    with small_batches(spark):
        some = written(rows.mapInArrow(_promising(limit), "key long, rep long, comp long, size long").distinct(), "nd-some")
    many = some.groupBy("key").agg(F.sum("size").alias("values"), F.count("*").alias("c"))
    rows = some.drop("size").join(many, "key").join(fine, "rep").join(sets, "rep")
    rows = _dealt(rows, F.least(F.ceil(F.col("values") / BLOCK_VALUES), F.col("c")))
    with small_batches(spark):
        return written(rows.mapInArrow(_joining(limit, num, den), "a long, b long").distinct(), "nd-more")


def near_classes(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, _tk, n_shingles, component_id, kept) for every distinct (doc_id, text) row."""
    sig = written(signatures(docs, k).dropDuplicates(["doc_id", "_tk"]), "nd-sig")
    full = sig.where("n > 0")
    cls = full.groupBy("n", "s1", "s2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_tk", "sig")).alias("m"))
    # a class is named by a hash of its set; its first document represents it
    reps = written(cls.select(F.xxhash64("n", "s1", "s2").alias("rep"), F.col("m.doc_id").alias("doc_id"),
                              F.col("m._tk").alias("_tk"), F.col("m.sig").alias("sig")), "nd-reps")
    rows = bucket_rows(reps)
    lead = rows.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("c")).where("c > 1").select("key", "a")
    member = written(rows.join(lead, "key"), "nd-bucket")                       # buckets of two or more
    sets = sets_of(member.select("rep").distinct(), reps, docs, k)
    stars = written(member.where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "nd-pairs")
    links = written(verified(stars, sets, num, den), "nd-links")
    comp = components(links)
    # buckets that still hold more than one component
    named = member.join(comp, member["rep"] == comp["node"], "left").select("key", "place", "rep", F.coalesce("comp", "rep").alias("comp"))
    open_ = (named.groupBy("key", "place").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c"),
                                               F.bit_xor(F.xxhash64("rep")).alias("m1"), F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("m2"))
             .where("x <> y and c > 2"))
    # of buckets with the same members the first holds every pair's first common bucket among them
    open_ = open_.groupBy("c", "m1", "m2").agg(F.min(F.struct("place", "key")).alias("f")).select(F.col("f.key").alias("key"), "c")
    left = written(named.drop("place").join(open_, "key"), "nd-open")
    more = open_links(left, sets, num, den)
    if more.limit(1).count():
        comp = components(links.union(more))
    # back to documents: class → component → smallest document id
    doc = sig.select("doc_id", "_tk", "n", F.when(F.col("n") > 0, F.xxhash64("n", "s1", "s2")).alias("rep"))
    cid = reps.select("rep", F.col("doc_id").alias("rep_doc")).join(comp, reps["rep"] == comp["node"], "left").select("rep", "rep_doc", F.coalesce("comp", "rep").alias("comp"))
    small = cid.groupBy("comp").agg(F.min("rep_doc").alias("component_id"))
    cid = cid.join(small, "comp").select("rep", "component_id")
    out = doc.join(cid, "rep", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_tk", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document row."""
    cls = near_classes(docs, k, num, den)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key(F.col("text").cast("string")).alias("_t"))
    again = rows.groupBy("_id", "_t").agg(F.count("*").alias("c")).where("c > 1")
    # repeated rows get a row each
    out = cls.join(again, cls["doc_id"].eqNullSafe(again["_id"]) & (cls["_tk"] == again["_t"]), "left")
    out = out.withColumn("c", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("c"), F.lit(1)).cast("int"))))
    return out.select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, k: int = 3, num: int = 85, den: int = 100) -> DataFrame:
    """One document row of each component, that with the smallest id; of repeated (id, text) rows
    one stays. Other columns pass through."""
    key = F.xxhash64(F.col("doc_id").cast("long"), text_key(F.col("text").cast("string")))
    keep = near_classes(docs, k, num, den).where("kept").select(
        F.col("doc_id").alias("_lx_id"), F.col("_tk").alias("_lx_tk"), F.xxhash64("doc_id", "_tk").alias("_lx_k"))
    rows = docs.withColumn("_lx_key", key)
    j = rows.join(keep, (rows["_lx_key"] == keep["_lx_k"]) & rows["doc_id"].cast("long").eqNullSafe(keep["_lx_id"])
                  & (text_key(rows["text"].cast("string")) == keep["_lx_tk"]))
    # hashed on the join key already: numbering repeated rows shuffles nothing
    w = Window.partitionBy("_lx_key", "_lx_id", "_lx_tk").orderBy("_lx_key")
    return j.withColumn("_lx_n", F.row_number().over(w)).where("_lx_n = 1").select(*[rows[c] for c in docs.columns])
