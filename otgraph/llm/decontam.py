"""Benchmark decontamination by q-gram lemma filtering.

Texts are reduced to their lower-cased letters and digits. An item is found in a document if ``window`` letters of it in
a row (all of them in shorter items), from any letter on, occur there with at most ``e`` edits. Such a window
shares at least ``window - q + 1 - e*q`` of its q-grams with the document, all on diagonals no
more than ``e`` apart. So per (document, item) the shared q-grams are counted in overlapping
diagonal bands, for the window at every letter; windows that reach the bound are verified by alignment inside their band,
all windows of a band at once (bit-parallel, a window is one machine word). Items with fewer than ``q`` letters are found
where a line of the document has just their letters.

The benchmark is dealt to blocks of about ``block_chars`` characters by a hash; a block's index is built in a task, and one
block at a time is broadcast and scanned. With several blocks their hits are united per document.

Defined results: null and empty texts are clean, and items without letters are never found; repeated benchmark rows
act once per ``item_id``; null item ids are reported as -1; repeated document rows get equal verdicts; an empty benchmark leaves
all documents clean, an empty table gives none; extra columns of any name are ignored or pass through; long
texts are scanned in stretches of ``STRETCH`` letters that overlap by more than a window with its edits.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.llm.common import chunked, text_key, written

Q = 12                 # q-gram length
WINDOW = 64            # characters of a benchmark window, 64 at most
STRETCH = 4096         # letters of a text whose shared q-grams are listed at a time
EDIT_RATE = 0.0625     # edits allowed per window character
BLOCK_CHARS = 2_000_000  # benchmark characters per broadcast block (the proven bound)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLES: list = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter or digit, and its lower-case code point."""
    if not _TABLES:
        keep = np.zeros(0x110000, bool)
        low = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalnum():
                keep[c] = True
                t = s.lower()
                if len(t) == 1:
                    low[c] = ord(t)
        _TABLES.append((keep, low))
    return _TABLES[0]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and digits of a text, and the code point position of each."""
    keep, low = _tables()
    c = codes_of(text)
    at = np.flatnonzero(keep[c])
    return low[c[at]], at


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size = c.astype(np.uint64), 1              # hashes of runs of ``size`` characters
    for bit in bin(q)[3:]:                        # by doubling: run + run, then one more
        h = h[:-size] * _U(pow(_BASE, size, 1 << 64)) + h[size:]
        size *= 2
        if bit == "1":
            h = h[:-1] * _U(_BASE) + c[size:size + len(h) - 1]
            size += 1
    return h ^ (h >> _U(29))


def edits_allowed(m: int, q: int, rate: float) -> int:
    """Edit budget of a pattern of m characters; never so large that the lemma's bound is 0."""
    return max(0, min(int(m * rate), (m - q) // q))


def build_index(items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, rate: float = EDIT_RATE) -> dict:
    """Sorted q-gram hashes of a block of benchmark items with their (item, position); short items by their letters."""
    codes, hs, its, pos, wins, short = [], [], [], [], [], {}
    for k, (_, text) in enumerate(items):
        c, _at = normalise(text or "")
        codes.append(c)
        h = gram_hashes(c, q)
        hs.append(h)
        its.append(np.full(len(h), k, np.int32))
        pos.append(np.arange(len(h), dtype=np.int32))
        wins.append(min(window, len(c)))
        if 0 < len(c) < q:
            short.setdefault(c.tobytes(), []).append(k)
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    filt = np.zeros(1 << 22, bool)
    filt[(h >> _U(42)).astype(np.int64)] = True
    cat = lambda x: (np.concatenate(x) if x else np.zeros(0, np.int32))[order]
    return {"ids": [i if i is not None else -1 for i, _ in items], "codes": codes, "wins": wins, "short": short,
            "h": h, "item": cat(its), "pos": cat(pos), "filter": filt, "q": q, "rate": rate}


def window_edits(p: np.ndarray, m: int, first: int, last: int, t: np.ndarray) -> np.ndarray:
    """Least edits that turn p[s:s + m] into some piece of ``t``, for every s from ``first`` to ``last``: one column of the edit
    distance per letter of t, as bits that tell its steps up and down; m is 64 at most."""
    seg = p[first:last + m]
    n = last - first + 1
    masks: dict[int, np.ndarray] = {}
    none = np.zeros(n, _U)
    bit = _U(1) << np.arange(m, dtype=_U)
    for c in np.unique(seg):
        masks[int(c)] = (np.lib.stride_tricks.sliding_window_view(seg == c, m) * bit).sum(axis=1, dtype=_U)
    up, down = np.full(n, (1 << m) - 1, _U), np.zeros(n, _U)
    score = np.full(n, m, np.int64)
    best, top, one = score.copy(), _U(m - 1), _U(1)
    for c in t.tolist():
        eq = masks.get(c, none)
        x = eq | down
        d = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(d | up), up & d
        score += (rise >> top & one).astype(np.int64) - (fall >> top & one).astype(np.int64)
        rise, fall = rise << one, fall << one
        up, down = fall | ~(x | rise), rise & x
        best = np.minimum(best, score)
    return best


def _pairs(gram: np.ndarray, hits: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, position in it, position in the text) of every q-gram that both have."""
    hi = np.searchsorted(index["h"], index["h"][gram], side="right")
    n = hi - gram
    ix = np.repeat(gram, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return index["item"][ix], index["pos"][ix].astype(np.int64), np.repeat(hits, n)


def _candidates(ip: np.ndarray, d: np.ndarray, m: int, size: int, e: int, need: int, q: int) -> list[tuple[int, int, int, int]]:
    """(first window, last window, least and greatest diagonal) of the runs of windows that share enough q-grams in a band."""
    diag, out = d - ip, []
    width = e + 1
    for shift in (0, 1):                              # bands of 2(e+1) diagonals, starting every e+1
        band = (diag // width + shift) // 2
        order = np.lexsort((ip, band))
        for group in np.split(order, np.flatnonzero(np.diff(band[order])) + 1):
            if len(group) < need:
                continue
            p = np.unique(ip[group])
            if len(p) < need:
                continue
            s = np.arange(max(0, int(p[0]) - m), min(size - m, int(p[-1])) + 1)
            # the q-grams of the window at s begin from s to s + m - q
            on = s[np.searchsorted(p, s + m - q, side="right") - np.searchsorted(p, s) >= need]
            if len(on):
                for run in np.split(on, np.flatnonzero(np.diff(on) > 1) + 1):
                    out.append((int(run[0]), int(run[-1]), int(diag[group].min()), int(diag[group].max())))
    return out


def find_items(c: np.ndarray, at: np.ndarray, hits: np.ndarray, gram: np.ndarray, index: dict) -> list[tuple[int, int, int]]:
    """Verified (item id, start, end) of one text: from the first verified window's place to the last one's. ``hits`` are
    q-gram positions in ``c`` whose hash stands at ``gram`` in the index."""
    q, rate, out = index["q"], index["rate"], {}
    if not len(hits):
        return []
    lap = 2 * (WINDOW + WINDOW // q)
    stretches = [(x, x + STRETCH + lap) for x in range(int(hits[0]) // STRETCH * STRETCH, int(hits[-1]) + 1, STRETCH)]
    # from the left until each item was found, then from the right: what lies between adds nothing
    for side, todo in enumerate((stretches, stretches[::-1])):
        closed: set[int] = set()
        for x, y in todo:
            u, v = np.searchsorted(hits, x), np.searchsorted(hits, y)
            if u == v:
                continue
            item, ip, d = _pairs(gram[u:v], hits[u:v], index)
            order = np.argsort(item, kind="stable")
            cuts = np.flatnonzero(np.diff(item[order])) + 1
            for group in np.split(order, cuts):
                k = int(item[group[0]])
                m = index["wins"][k]
                e = edits_allowed(m, q, rate)
                need = m - q + 1 - e * q
                if k in closed or len(group) < need or side and k not in out:
                    continue
                p = index["codes"][k]
                runs = [(max(0, s0 + lo - e), min(len(c), s1 + m + hi + e), s0, s1) for s0, s1, lo, hi in _candidates(ip[group], d[group], m, len(p), e, need, q)]
                for a, b, s0, s1 in sorted(runs, key=(lambda r: r[0]) if not side else (lambda r: -r[1])):
                    if side and b <= out[k][1]:
                        closed.add(k)
                        break
                    ok = np.flatnonzero(window_edits(p, m, s0, s1, c[a:b]) <= e)
                    if len(ok):
                        old = out.get(k, (a, b))
                        out[k] = (min(a, old[0]), max(b, old[1]))
                        closed.add(k)
                        break
    return [(index["ids"][k], int(at[a]), int(at[b - 1]) + 1) for k, (a, b) in out.items()]


def short_items(text: str, index: dict) -> list[tuple[int, int, int]]:
    """(item id, start, end) of the lines that have just the letters of a short item."""
    out, start = {}, 0
    for line in text.split("\n"):
        c, at = normalise(line) if len(line) < 1000 else (None, None)
        for k in index["short"].get(c.tobytes(), ()) if c is not None and len(c) else ():
            a, b = out.get(k, (start + int(at[0]), 0))
            out[k] = (a, start + int(at[-1]) + 1)
        start += len(line) + 1
    return [(index["ids"][k], a, b) for k, (a, b) in out.items()]


def scan_texts(texts: list, indexes: list[dict]) -> list[list[tuple[int, int, int]]]:
    """Benchmark items found in each text, over all index blocks."""
    found: list[list] = [[] for _ in texts]
    keep, low = _tables()
    for a, b in chunked(texts):
        part = [t or "" for t in texts[a:b]]
        c = codes_of("\n".join(part))
        ends = np.cumsum([len(t) + 1 for t in part])
        at = np.flatnonzero(keep[c])
        codes = low[c[at]]
        begin = np.concatenate(([0], ends[:-1]))
        first = np.append(np.searchsorted(at, begin), len(at))
        for index in indexes:
            h = gram_hashes(codes, index["q"])
            if not len(h) or not len(index["h"]):
                continue
            cand = np.flatnonzero(index["filter"][(h >> _U(42)).astype(np.int64)])
            spot = np.searchsorted(index["h"], h[cand])
            good = (spot < len(index["h"])) & (index["h"][np.minimum(spot, len(index["h"]) - 1)] == h[cand])
            cand, spot = cand[good], spot[good]
            own = np.searchsorted(first, cand, side="right") - 1
            inside = cand + index["q"] <= first[own + 1]
            cand, spot, own = cand[inside], spot[inside], own[inside]
            for k in np.unique(own):
                x, y = np.searchsorted(own, k), np.searchsorted(own, k, side="right")
                lo, hi = first[k], first[k + 1]
                found[a + k] += find_items(codes[lo:hi], at[lo:hi] - begin[k], cand[x:y] - lo, spot[x:y], index)
        for index in indexes:
            if index["short"]:
                for k, text in enumerate(part):
                    found[a + k] += short_items(text, index)
    return found


def index_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS, **params) -> DataFrame:
    """(block, index): the benchmark (the stated query set) as pickled indexes of bounded size, built in tasks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = written(items, "leak-items")
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_chars))

    def build(table):
        rows = sorted(zip(table.column("item_id").to_pylist(), table.column("text").to_pylist()), key=lambda r: (r[0] is None, r))
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "index": pa.array([pickle.dumps(build_index(rows, **params))], pa.binary())})

    blocks = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    return written(blocks.groupBy("block").applyInArrow(build, "block int, index binary"), "leak-index")


def _each_block(benchmark: DataFrame, params: dict):
    """One broadcast index after the other."""
    blocks = index_blocks(benchmark, **params)
    for b in sorted(r["block"] for r in blocks.select("block").collect()):
        raw = bytes(blocks.where(F.col("block") == b).first()["index"])
        yield blocks.sparkSession.sparkContext.broadcast(pickle.loads(raw))


def _found(docs: DataFrame, benchmark: DataFrame, params: dict) -> DataFrame:
    """(doc_id, _tk, items, spans) of the contaminated documents: one scan per block, hits united per document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", text_key(F.col("text")).alias("_tk"), "text")
    hit = "struct<item:bigint,start:bigint,stop:bigint>"
    parts = None
    for block in _each_block(benchmark, params):
        def run(batches, block=block):
            for batch in batches:
                found = scan_texts(batch.column("text").to_pylist(), [block.value])
                on = pa.array([i for i, f in enumerate(found) if f], pa.int64())
                hits = [[{"item": i, "start": s, "stop": e} for i, s, e in f] for f in found if f]
                kind = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(on), batch.column("_tk").take(on), pa.array(hits, kind)], names=["doc_id", "_tk", "hits"])

        part = written(rows.mapInArrow(run, f"doc_id long, _tk long, hits array<{hit}>"), "leak-hits")
        parts = part if parts is None else parts.unionByName(part)
        block.unpersist()
    if parts is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, _tk long, items array<long>, spans string")
    # repeated rows have equal hits: one set
    one = parts.groupBy("doc_id", "_tk").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"))
    by_place = F.array_sort(F.transform("hits", lambda x: F.struct(x["start"].alias("start"), x["item"].alias("item"), x["stop"].alias("stop"))))
    spans = F.array_join(F.transform(by_place, lambda x: F.concat_ws(":", x["item"], x["start"], x["stop"])), ",")
    return one.select("doc_id", "_tk", F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item"]))).alias("items"), spans.alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """One row per document: ``doc_id``, ``contaminated``, ``items`` (ids found, ascending) and
    ``spans`` (code point ranges ``item:start:end``)."""
    found = _found(docs, benchmark, params).withColumnsRenamed({"doc_id": "_id", "_tk": "_t"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("_tk"))
    j = rows.join(found, rows["doc_id"].eqNullSafe(found["_id"]) & (rows["_tk"] == found["_t"]), "left")
    return j.select("doc_id", F.col("_t").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"),
                    F.coalesce("spans", F.lit("")).alias("spans"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The documents without contaminated ones; every column passes through unchanged."""
    found = _found(docs, benchmark, params).select(F.col("doc_id").alias("_lx_id"), F.col("_tk").alias("_lx_tk"))
    same = docs["doc_id"].cast("long").eqNullSafe(found["_lx_id"]) & (text_key(docs["text"].cast("string")) == found["_lx_tk"])
    return docs.join(found, same, "left_anti")
