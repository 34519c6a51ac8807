"""Periodic runs of words, found online by catching squares over dyadic blocks.

A run is a maximal stretch of consecutive words with smallest period q and length >= max(``LEAST``,
``EXPONENT`` * q). Words are appended to a stream. For each level k every completed block of b = 2^k words is a
catcher for the periods b <= q < 2b: it waits for its own words to come back q words later. Each window of
b words that an appended word completes has exactly one catcher at such a distance, so a word costs one suffix comparison a
level (of prefix hashes). A run of period q holds a whole block and the block's copy, for it is four periods long, so
none escapes. Catches of neighbouring blocks at the same distance are overlapping squares: they merge into
chains, also across appends, and a chain becomes a run when its ends are compared word by word. Chains
inside a run whose period divides theirs are that run again and go.

Documents of a batch form one stream with a separator between them that equals no word. Words are compared
by their number in the stream's vocabulary, exactly; hashes only propose.

Defined results: null, empty and blank texts have no words and no runs (the hash of the empty string, null run); a
null doc_id has no crc32, its words stay as they are; repeated rows get equal results; an empty table gives no
rows; of runs with the same exponent the first start, then the least period is reported; extra columns of any
name are ignored. A very long text is split and appended in pieces of ``PIECE_BYTES``; memory
is 40 bytes a word and its distinct words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.llm.common import mix

EXPONENT, LEAST = 4, 6
STREAM_BYTES = 2_000_000              # texts of one stream; a longer single text is its own
PIECE_BYTES = 1 << 20                 # appended at a time
PIECE_WORDS = 1 << 17

_U = np.uint64
_X = _U(0x9E3779B97F4A7C15)           # odd: its powers never vanish


class Catchers:
    """The state of one stream: words, prefix hashes and the open chains of each level. ``longest``: words that
    a run can have at most (of the longest document)."""

    def __init__(self, size: int, longest: int):
        self.word = np.empty(size, np.int64)
        self.prefix = np.zeros(size + 1, _U)              # sum of hash(word i) * X^i
        self.power = np.cumprod(np.concatenate((np.ones(1, _U), np.full(max(1, longest), _X))))
        self.shift = _U(1)                                # X^n
        self.n = 0
        self.levels = max(0, (longest // EXPONENT).bit_length())
        self.chains: list[list[np.ndarray]] = [[] for _ in range(self.levels)]

    def append(self, words: np.ndarray) -> None:
        """Advance every catcher by these words."""
        a, m = self.n, len(words)
        if not m:
            return
        self.word[a:a + m] = words
        step = np.full(m + 1, _X)
        step[0] = self.shift
        step = np.cumprod(step)
        self.shift = step[-1]
        self.prefix[a + 1:a + m + 1] = self.prefix[a] + np.cumsum(mix(words.view(_U) * _U(3) + _X) * step[:-1])
        self.n = a + m
        for k in range(self.levels):
            caught = self._caught(k, a)
            if len(caught):
                self.chains[k].append(_merged(_chains(caught, k)))

    def _caught(self, k: int, before: int) -> np.ndarray:
        """Starts of the windows of 2^k words, completed since there were ``before`` words, that equal their catcher."""
        b = 1 << k
        lo, hi = max(b, before - b + 1), self.n - b + 1
        if lo >= hi:
            return np.zeros(0, np.int64)
        at = np.arange(lo, hi)
        block = (at & -b) - b
        row = np.arange(block[0], block[-1] + 1, b)
        sums = self.prefix[row + b] - self.prefix[row]
        want = sums[(block - block[0]) >> k] * self.power[at - block]
        return at[(self.prefix[lo + b:hi + b] - self.prefix[lo:hi]) == want]

    def runs(self) -> np.ndarray:
        """(start, end, period) of all runs, by start, then period."""
        found: list[np.ndarray] = []
        for k, parts in enumerate(self.chains):
            if not parts:
                continue
            b = 1 << k
            off, first, last = _merged(np.concatenate(parts, 1))
            q = off + b
            c0, c1 = (first - 1) * b, last * b             # words from c0 to c1 equal those q later
            least = np.maximum(LEAST - q, (EXPONENT - 1) * q)
            on = (c1 - c0 + 2 * (b - 1) >= least) & ~_inside(found, c0, c1 + q, q)
            new = [r for x in np.flatnonzero(on) for r in self._stretches(int(c0[x]), int(c1[x]), int(q[x]), b, int(least[x]))]
            if new:
                r = np.array(sorted(set(new)), np.int64).T
                r = r[:, ~_inside(found, *r)]              # where hashes were equal by chance
                if r.shape[1]:
                    found.append(r)
        if not found:
            return np.zeros((0, 3), np.int64)
        out = np.concatenate(found, 1)
        return out[:, np.lexsort((out[2], out[0]))].T

    def _stretches(self, c0: int, c1: int, q: int, b: int, least: int) -> list[tuple[int, int, int]]:
        """Runs of period q around a chain: its ends lie less than a block outside."""
        x0, x1 = max(0, c0 - b), min(self.n - q, c1 + b)
        cut = x0 + np.flatnonzero(self.word[x0:x1] != self.word[x0 + q:x1 + q])
        lo, hi = np.append(x0 - 1, cut) + 1, np.append(cut, x1)
        return [(int(s), int(e) + q, q) for s, e in zip(lo, hi) if e - s >= least]


def _inside(found: list[np.ndarray], start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether each stretch lies in a run of a lower level whose period divides its period. Two runs of one level
    share less than four blocks, so the last that starts before the stretch is the only one to ask."""
    out = np.zeros(len(start), bool)
    for known in found:
        at = np.searchsorted(known[0], start, "right") - 1
        _, e, p = known[:, np.maximum(at, 0)]
        out |= (at >= 0) & (e >= end) & (q % p == 0)
    return out


def _chains(at: np.ndarray, k: int) -> np.ndarray:
    """(offset in the block, row, row) of each caught window; the distance is the offset plus a block."""
    return np.stack([at & ((1 << k) - 1), at >> k, at >> k])


def _merged(c: np.ndarray) -> np.ndarray:
    """Chains of equal distance whose blocks follow one another become one."""
    c = c[:, np.lexsort((c[1], c[0]))]
    new = np.append(True, (c[0, 1:] != c[0, :-1]) | (c[1, 1:] != c[2, :-1] + 1))
    return np.stack([c[0, new], c[1, new], c[2, np.append(np.flatnonzero(new)[1:] - 1, c.shape[1] - 1)]])


def _split(raw: bytes):
    """Words of a text, in pieces that end at white space."""
    a = 0
    while a < len(raw):
        b = min(len(raw), a + PIECE_BYTES)
        while b < len(raw) and raw[b] not in b" \t\n\v\f\r":       # a word is never cut
            b += 1
        yield raw[a:b].split()                                      # bytes: exactly these six separators
        a = b


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """The original word that each word becomes where the document is one of those with a planted period, else None."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def _summary(doc: np.ndarray, runs: np.ndarray, names: list[bytes]) -> tuple:
    """Columns of one document from its words and its runs (start, end, period)."""
    keep = np.ones(len(doc), bool)
    best, lines = None, []
    for s, e, q in runs.tolist():
        keep[s + q:e] = False
        lines.append(f"{s},{e - s},{q}\n")
        if best is None or (e - s) * best[2] > best[1] * q:
            best = (s, e - s, q)
    sha = hashlib.sha256()
    kept = doc[keep]
    for a in range(0, len(kept), PIECE_WORDS):
        sha.update((b" " if a else b"") + b" ".join(map(names.__getitem__, kept[a:a + PIECE_WORDS].tolist())))
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256("".join(lines).encode()).hexdigest(), sha.hexdigest())


def document_runs(texts: list[bytes], ids: list, change=planted) -> list[tuple]:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each text."""
    vocabulary: dict = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    docs = []
    for raw, doc_id in zip(texts, ids):
        parts = [np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)) for words in _split(raw)]
        doc = np.concatenate([np.zeros(0, np.int64), *parts])
        place = change(len(doc), doc_id) if change else None
        docs.append(doc if place is None else doc[place])
    start = np.cumsum([0, *(len(d) + 1 for d in docs)])
    c = Catchers(int(start[-1]), max(map(len, docs), default=0))
    stream: list[np.ndarray] = []
    held = 0
    for i, d in enumerate(docs):
        for a in range(0, len(d), PIECE_WORDS):
            stream.append(d[a:a + PIECE_WORDS])
            held += len(stream[-1])
            if held >= PIECE_WORDS:
                c.append(np.concatenate(stream))
                stream, held = [], 0
        stream.append(np.array([-1 - i]))                           # separator
    c.append(np.concatenate([np.zeros(0, np.int64), *stream]))
    runs = c.runs()
    of = np.searchsorted(runs[:, 0], start)
    names = list(vocabulary)
    return [_summary(d, runs[of[i]:of[i + 1]] - [start[i], start[i], 0], names) for i, d in enumerate(docs)]


def periodic_runs(docs: DataFrame, change=planted) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli; null without runs), the
    hash of all runs and the hash of the words left when every run keeps its first period only. ``change``
    gives the words that stand for the originals (``None``: the texts as they are)."""
    schema = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")

    def run(batches):
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            ids, rows, a, size = batch.column("doc_id").to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                if i > a and size + len(t) > STREAM_BYTES:
                    rows += document_runs(texts[a:i], ids[a:i], change)
                    a, size = i, 0
                size += len(t)
            rows += document_runs(texts[a:], ids[a:], change)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
