"""Secret scan over a trigram inverted index.

Each rule's regex is parsed into a Boolean query of mandatory trigrams (AND over its literal runs, OR
over a run's alternatives). Every block of documents gets an inverted index of the trigrams that
the queries name (trigram → sorted rows of the block); the queries intersect and unite postings, and
only the rows left are verified with the regex, over their whole text. Rules without a mandatory
trigram scan every row. Blocks are the Arrow batches Spark hands to a task, so the index is as
distributed as the data and nothing is shuffled.

The base kinds are ``assign``, ``access`` and ``hex``; the further rules add spans of other kinds and
never change base ones. Spans are code point offsets, end exclusive; of one kind leftmost and
not overlapping.

Defined results: null and empty texts have no spans (``base_sha256`` is that of the empty string);
repeated rows get equal results; null ids pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.llm.common import chunked

# Fixed values: (kind, regex, group that must have the length, least length). A run of hex digits
# under 16 never counts, so its rule asks for 16 at once: the runs found are the same. If a rule has a
# group ``span``, that is the span; url_login looks at each run of scheme characters once.
RULES = [
    ("assign", r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
               r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("stripe", r"[sr]k_(?:live|test)_[0-9a-zA-Z]{16,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("url_login", r"(?<![a-z0-9+.-])[0-9+.-]*+(?P<span>[a-z][a-z0-9+.-]++://[^\s/:@]++:[^\s/:@]++@)", 0, 0),
]
BASE = ("assign", "access", "hex")
MAX_ALTERNATIVES = 256


# ---- regex → Boolean trigram query -----------------------------------------------------------
def _alternatives(node) -> set[str] | None:
    """The lower-cased strings a parsed node can match, if they are few; None otherwise."""
    op, av = node
    if op is C.LITERAL:
        return {chr(av).lower()}
    if op is C.IN:
        out = set()
        for kind, v in av:
            if kind is C.LITERAL:
                out.add(chr(v).lower())
            elif kind is C.RANGE and v[1] - v[0] < 8:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out
    if op is C.SUBPATTERN:
        return _sequence(av[-1])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in av[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is C.MAX_REPEAT:
        low, high, body = av
        one = _sequence(body)
        if one is None or int(high) > 1:
            return None
        return one | ({""} if low == 0 else set())
    if op is C.AT:
        return {""}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        alt = _alternatives(node)
        if alt is None or len(out) * len(alt) > MAX_ALTERNATIVES:
            return None
        out = {a + b for a, b in itertools.product(out, alt)}
    return out


def _runs(nodes) -> list[set[str]]:
    """Consecutive stretches of a parsed regex that can match few strings only."""
    runs, now = [], {""}
    for node in nodes:
        alt = _alternatives(node)
        if alt is not None and len(now) * len(alt) <= MAX_ALTERNATIVES:
            now = {a + b for a, b in itertools.product(now, alt)}
            continue
        runs.append(now)
        now = {""}
        if alt is not None:
            now = alt
        elif node[0] is C.SUBPATTERN:
            runs += _runs(node[1][-1])
        elif node[0] is C.MAX_REPEAT and node[1][0] >= 1:
            runs += _runs(node[1][2])
    return [*runs, now]


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """AND of ORs of ANDs: [[{trigrams of one alternative}, ...], ...]; [] means scan all."""
    query = []
    for run in _runs(parser.parse(regex)):
        alts = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run]
        if alts and all(alts):
            query.append(sorted(set(alts), key=sorted))
    return query


# ---- block index ---------------------------------------------------------------------------
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class Scanner:
    def __init__(self, rules=RULES):
        self.kinds = [k for k, *_ in rules]
        self.rules = [(re.compile(r), g, n) for _, r, g, n in rules]
        self.queries = [trigram_query(r) for _, r, *_ in rules]
        grams = sorted({t for q in self.queries for alts in q for a in alts for t in a})
        # non-ASCII literals are not indexed: their rules fall back to a full scan
        self.queries = [q if all(t.isascii() for alts in q for a in alts for t in a) else [] for q in self.queries]
        self.number = {t: i + 1 for i, t in enumerate(t for t in grams if t.isascii())}
        self.lut = np.zeros(1 << 24, np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode()
            self.lut[a << 16 | b << 8 | c] = i

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """The block's inverted index: trigram → ascending rows."""
        enc = [t.encode("utf-8", "surrogatepass") for t in texts]
        b = _LOW[np.frombuffer(b"\x00".join(enc) + b"\x00\x00", np.uint8)].astype(np.int32)
        ends = np.cumsum([len(e) + 1 for e in enc])
        ids = self.lut[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(ids)
        row = np.searchsorted(ends, at, side="right")
        both = np.unique(ids[at].astype(np.int64) * len(texts) + row)
        num, row = both // len(texts), both % len(texts)
        return {t: row[np.searchsorted(num, i):np.searchsorted(num, i, side="right")] for t, i in self.number.items()}

    def candidates(self, query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
        rows = np.arange(n)
        for alts in query:
            hit = [np.zeros(0, np.int64)]
            for grams in alts:
                got = None
                for t in sorted(grams, key=lambda t: len(index[t])):
                    got = index[t] if got is None else np.intersect1d(got, index[t], assume_unique=True)
                hit.append(got)
            rows = np.intersect1d(rows, np.concatenate(hit))
        return rows

    def scan(self, texts: list) -> list[list[tuple[int, int, int]]]:
        """Per text its (start, rule number, end), ascending."""
        found: list[list] = [[] for _ in texts]
        for a, b in chunked(texts):
            part = [t or "" for t in texts[a:b]]
            index = self.postings(part)
            for k, ((regex, group, least), query) in enumerate(zip(self.rules, self.queries)):
                rows = self.candidates(query, index, len(part)) if query else range(len(part))
                span = regex.groupindex.get("span", 0)
                for i in rows:
                    for m in regex.finditer(part[i]):
                        if m.end(group) - m.start(group) >= least:
                            found[a + i].append((m.start(span), k, m.end(span)))
        for f in found:
            f.sort()
        return found


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans per document row."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
    holder: list[Scanner] = []

    def run(batches):
        if not holder:
            holder.append(Scanner(rules))
        scanner = holder[0]
        base = {k for k, kind in enumerate(scanner.kinds) if kind in BASE}
        say = lambda spans: ",".join(f"{scanner.kinds[k]}:{s}:{e}" for s, k, e in spans)
        for batch in batches:
            found = scanner.scan(batch.column("text").to_pylist())
            counts = [pa.array([sum(scanner.kinds[k] == kind for _, k, _ in f) for f in found], pa.int64()) for kind in BASE]
            sha = [hashlib.sha256(say([x for x in f if x[1] in base]).encode()).hexdigest() for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array([say(f) for f in found], pa.string()),
                 pa.array([len(f) for f in found], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
