"""Quality rules: hashed word and character n-gram logistic regression, calibrated.

Features of a text are the shares of its hashed word 1- and 2-grams and of its hashed character
4-grams in two tables of 2^18 weights (bounded, the same at every size). The regression is
fitted on at most ``FIT_ROWS`` labelled rows and ``FIT_CHARS`` characters, taken in the order of a hash of
the id (texts that do not fit are passed over; if none of a label fits, its shortest is taken); a fifth of them is kept apart to calibrate the probability (Platt). Scoring runs in Arrow
batches over whole texts and compares the probability with the fixed ``THRESHOLD``.

Next to the verdict stand counts with fixed limits: word characters, symbols, repeated lines, words in
5-word windows that occur twice or more. A document fails the base rules with fewer than 10 words or
when over 20 percent of its words stand in repeated windows.

Defined results: null text has no words and fails; empty likewise; conflicting label rows of one id
take the lower; null labels are ignored; without texts of both labels the classifier keeps everything;
repeated rows get equal results; extra columns of any name are ignored; very long texts are scored whole, a chunk of
their own; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.llm.common import Words, chunked, mix, sample_texts

HASH_BITS = 18
CHAR_N = 4
FIT_ROWS, FIT_CHARS = 4000, 7_000_000
THRESHOLD = 0.5
MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "#*$%&|<>"
SCALE = 40.0          # shares are small: brings features to the order of 1

_U = np.uint64
_SYM = np.zeros(256, bool)
_SYM[[ord(c) for c in SYMBOLS]] = True


def _per_text(flags: np.ndarray, w: Words, n: int) -> np.ndarray:
    """Sum of per-byte flags of each text."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    edge = np.append(w.text_start, len(w.buf))
    return total[edge[1:]] - total[edge[:-1]]


def word_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all word 1- and 2-grams."""
    two, at = w.windows(2)
    h = np.concatenate([w.hash, two * _U(3) + _U(1)])
    return np.concatenate([w.doc, w.doc[at]]), (mix(h) >> _U(64 - HASH_BITS)).astype(np.int64)


def char_grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all character 4-grams inside one text; blanks of any kind are one character."""
    lead = (w.buf & 0xC0) != 0x80                          # first bytes of characters
    c = np.frombuffer(w.buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(w.sep[lead], np.uint32(32), c)
    m = max(0, len(c) - CHAR_N + 1)
    h = np.zeros(m, np.uint32)
    for i in range(CHAR_N):
        h = (h ^ c[i:m + i]) * np.uint32(2654435761)
    bucket = (h ^ h >> np.uint32(15)) * np.uint32(2246822519) >> np.uint32(32 - HASH_BITS)
    first = (np.cumsum(lead) - 1)[w.text_start] if len(w.text_start) else np.zeros(0, np.int64)
    own = np.full(len(c), -1)
    own[int(first[0]) if len(first) else len(c):] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(c))))
    ok = (own[:m] >= 0) & (own[:m] == own[CHAR_N - 1:])
    return own[:m][ok], bucket[ok].astype(np.int64)


def base_counts(texts: list, w: Words) -> dict[str, np.ndarray]:
    n = len(texts)
    per = w.per_doc.astype(np.int64)
    chars = _per_text(~w.sep & ((w.buf & 0xC0) != 0x80), w, n)
    symbols = _per_text(_SYM[w.buf], w, n)
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        if t and "\n" in t:
            seen: set[str] = set()
            for line in t.split("\n"):
                if line.strip(" \t\n\v\f\r"):
                    if line in seen:
                        dup[i] += 1
                    seen.add(line)
    h, at = w.windows(WINDOW)
    repeat = np.zeros(n, np.int64)
    if len(h):
        h = mix(h + w.doc[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        eq = h[order][1:] == h[order][:-1]
        again = np.zeros(len(h), bool)
        again[order[1:][eq]] = True
        again[order[:-1][eq]] = True
        cover = np.zeros(w.n + 1, np.int64)
        np.add.at(cover, at[again], 1)
        np.add.at(cover, at[again] + WINDOW, -1)
        repeat = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {"n_words": per, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}


class Model:
    """Weights of the two tables, offset and calibration; no weights: keep everything."""

    def __init__(self, word=None, char=None, bias=0.0, platt=(0.0, 0.0)):
        self.word, self.char, self.bias, self.platt = word, char, bias, platt

    def margins(self, w: Words, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        for weights, (doc, bucket) in ((self.word, word_grams(w)), (self.char, char_grams(w))):
            size = np.bincount(doc, minlength=n)
            out += SCALE * np.bincount(doc, weights[bucket], minlength=n) / np.maximum(size, 1)
        return out

    def probability(self, w: Words, n: int) -> np.ndarray:
        if self.word is None:
            return np.ones(n)
        z = self.platt[0] * self.margins(w, n) + self.platt[1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (text, column, value) of both tables."""
    docs, cols, vals = [], [], []
    for a, b in chunked(texts, 500_000):
        w = Words(texts[a:b], lower=False)
        for shift, (doc, bucket) in ((0, word_grams(w)), (1 << HASH_BITS, char_grams(w))):
            key, count = np.unique(doc.astype(np.int64) << 32 | bucket, return_counts=True)
            d = key >> 32
            size = np.bincount(doc, minlength=b - a)
            docs.append((d + a).astype(np.int32))
            cols.append(((key & 0xFFFFFFFF) + shift).astype(np.int32))
            vals.append((SCALE * count / size[d]).astype(np.float32))
    return np.concatenate(docs), np.concatenate(cols), np.concatenate(vals)


def fit(texts: list[str], good: np.ndarray, apart: np.ndarray, share: tuple[float, float] = (1.0, 1.0), epochs: int = 80, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Full-batch Adagrad; rows ``apart`` calibrate. ``share``: labelled rows per sampled row of good
    and of bad texts, so the probability is that of the labelled population."""
    if not len(texts) or good.all() or not good.any():
        return Model()
    doc, col, val = _features(texts)
    y = good.astype(np.float64)
    use = ~apart if good[~apart].any() and not good[~apart].all() else np.ones(len(y), bool)
    weight = np.where(good, 0.5 / max(1, (good & use).sum()), 0.5 / max(1, (~good & use).sum())) * use
    w, square, bias, bias_sq = np.zeros(2 << HASH_BITS), np.full(2 << HASH_BITS, 1e-8), 0.0, 1e-8
    for _ in range(epochs):
        m = np.bincount(doc, val * w[col], minlength=len(y)) + bias
        g = weight * (1 / (1 + np.exp(-np.clip(m, -50, 50))) - y)
        grad = np.bincount(col, val * g[doc], minlength=len(w)) + decay * w
        square += grad * grad
        w -= rate * grad / np.sqrt(square)
        bias_sq += g.sum() ** 2
        bias -= rate * g.sum() / np.sqrt(bias_sq)
    m = np.bincount(doc, val * w[col], minlength=len(y)) + bias
    on = apart if apart.any() and good[apart].any() and not good[apart].all() else use
    x = np.stack([m[on], np.ones(on.sum())], 1)
    c = np.where(good[on], *share)
    n1, n0 = (c * y[on]).sum(), (c * (1 - y[on])).sum()
    t = np.where(y[on] > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    v = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (c * (t - p)) - 1e-3 * (v - [1, 0]))
        v = v + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    half = 1 << HASH_BITS
    return Model(w[:half].astype(np.float32), w[half:].astype(np.float32), float(bias), (float(v[0]), float(v[1])))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
           .where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")))
    count = {r[0]: r[1] for r in lab.groupBy(F.col("quality") > 0).count().collect()}
    rows, share = [], []
    for want in (True, False):
        got = sample_texts(docs, lab.where((F.col("quality") > 0) == want), FIT_ROWS // 2, FIT_CHARS // 2)
        rows += [(k, t, want) for k, t in got]
        share.append(count.get(want, 0) / max(1, len(got)))
    apart = np.array([k * 2654435761 % 4294967296 % 5 == 0 for k, _, _ in rows], bool)
    return fit([t for _, t, _ in rows], np.array([q for _, _, q in rows], bool), apart, tuple(share))


def judge(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the counts, base_failed, kept and probability per document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            cols, prob = {k: [] for k in names}, []
            for a, b in chunked(texts):
                w = Words(texts[a:b], lower=False)
                for k, v in base_counts(texts[a:b], w).items():
                    cols[k].append(v)
                prob.append(shared.value.probability(w, b - a))
            if not prob:
                continue
            c = {k: np.concatenate(v).astype(np.int64) for k, v in cols.items()}
            p = np.concatenate(prob)
            failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > REPEAT_PERCENT * c["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c[k]) for k in names], pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)],
                names=["doc_id", *names, "base_failed", "kept", "probability"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in names)
                           + ", base_failed boolean, kept boolean, probability double")
