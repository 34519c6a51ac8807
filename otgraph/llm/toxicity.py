"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel with Nyström
landmarks, trained on labelled sentences.

* **Kernel**: a power of ``K(x, z)``, which sums, over all common subsequences of ``P`` letters of a word ``x`` and
  a landmark ``z``, ``DECAY`` to the power of the letters they span in both, as a share of
  ``K(z, z)``. Characters inserted into an insult, or gaps in it, lower the value but do not
  zero it. Signs inside a word are dropped, runs of single letters ("a b c") are one word.
* **Sentence**: per landmark the largest kernel value of its words, mapped by the Nyström
  factor ``K_mm^(-1/2)``; the SVM is linear there.
* **Landmarks**: strings (words, word starts, word ends) of the toxic training documents, chosen
  greedily by how many not yet covered toxic documents they separate from clean ones.
* **Sentence labels**: sentences of clean documents are negative; of a toxic document the sentence
  with the largest response is the positive one, chosen again after each fit.
* **Document**: the largest sentence margin, calibrated to a probability.

The fit uses at most ``TOXIC_ROWS`` + ``CLEAN_ROWS`` labelled rows and ``SAMPLE_CHARS`` characters,
taken in the order of a hash of the id (texts that do not fit are passed over; if none of a label fits, its shortest is
taken), and only rows whose crc32(doc_id) mod 5 is not 0. Scoring
covers every character of every text.

Defined results: null or empty texts score as a text without any known word; conflicting label rows
of one id count as toxic; null labels or ids are ignored for fitting; without texts of both labels every
score is 0; repeated rows get equal scores; a null doc_id is held out (it has no remainder); extra columns of any name are
ignored or pass through; a very long word is scored in windows of ``WORD_CHARS``, ``PIECES`` at a time; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.llm.common import sample_texts

P = 4                   # subsequence length
DECAY = 0.6             # weight per spanned character
POWER = 2               # polynomial over the share of K(z, z): keeps near misses small
FLOOR = 0.1             # smaller values count as 0
MAX_LANDMARKS = 96
TOXIC_ROWS, CLEAN_ROWS, SAMPLE_CHARS = 1500, 3000, 15_000_000
WORD_CHARS = 40         # longer words are cut into windows of this length, half overlapping
MEMO_WORDS = 100_000    # words remembered while landmarks are chosen
PIECES = 100_000       # parts of words whose kernel is computed at a time
CACHE_WORDS = 500_000  # words a worker remembers before it starts afresh

_END = re.compile(r"[.!?]+(?:\s+|$)|\n")
_SIGN = re.compile(r"[^\w\s]+")
_SPELT = re.compile(r"(?<!\S)(?:\w ){2,}\w(?!\S)")


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of each sentence, signs dropped, spelt-out words joined. The kernel reads
    a word between the marks ``^`` and ``$`` (see ``windows``)."""
    t = _SIGN.sub("", _END.sub("\n", (text or "").lower()))
    t = _SPELT.sub(lambda m: m.group().replace(" ", ""), t)
    return [w for w in map(str.split, t.split("\n")) if w]


def windows(word: str) -> list[str]:
    """The word between start and end mark, cut into windows if it is very long."""
    word = f"^{word}$"
    if len(word) <= WORD_CHARS:
        return [word]
    step = WORD_CHARS // 2
    return [word[i:i + WORD_CHARS] for i in range(0, len(word) - step, step)]


class _Flat:
    """Strings as one code point array with offsets, and a bit per letter class of each."""

    def __init__(self, strings: list[str]):
        self.flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
        self.lens = np.fromiter(map(len, strings), np.int64, len(strings))
        self.start = np.cumsum(self.lens) - self.lens
        one = np.uint64(1) << (self.flat % 61).astype(np.uint64)
        self.bits = np.bitwise_or.reduceat(one, self.start) if len(one) else np.zeros(0, np.uint64)

    def rows(self, r: np.ndarray, pad: int) -> np.ndarray:
        at = np.arange(int(self.lens[r].max()))
        ok = at < self.lens[r, None]
        return np.where(ok, self.flat[np.where(ok, self.start[r, None] + at, 0)], pad)


def kernel_pairs(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of row pairs; pads of x and z never match."""
    n, a = x.shape
    b = z.shape[1]
    prev = np.ones((a + 1, b + 1, n), np.float32)
    d, d2 = np.float32(DECAY), np.float32(DECAY * DECAY)
    same = [[x[:, i] == z[:, j] for j in range(b)] for i in range(a)]
    for _ in range(P - 1):
        cur = np.zeros_like(prev)
        for i in range(1, a + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, b + 1):
                run = d * run + d2 * prev[i - 1, j - 1] * same[i - 1][j - 1]
                cur[i, j] = d * cur[i - 1, j] + run
        prev = cur
    out = np.zeros(n, np.float32)
    for i in range(a):
        for j in range(b):
            out += d2 * prev[i, j] * same[i][j]
    return out


def kernel(words: list[str], marks: list[str], cut: bool = True) -> np.ndarray:
    """(words x marks) kernel values as a share of K(z, z), at most 1; 0 for words that lack too
    many of a mark's letters (a third of them may be missing)."""
    out = np.zeros((len(words), len(marks)), np.float32)
    if not words or not marks:
        return out
    w, z = _Flat(words), _Flat(marks)
    zc = z.rows(np.arange(len(marks)), -1)
    own = kernel_pairs(np.where(zc < 0, -2, zc), zc)
    rows, cols = [], []
    for k, mark in enumerate(marks):
        n = len(set(mark))
        need = min(n - n // 3, int(np.bitwise_count(z.bits[k])))
        r = np.flatnonzero((np.bitwise_count(w.bits & z.bits[k]) >= need) & (w.lens >= P))
        rows.append(r)
        cols.append(np.full(len(r), k))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(w.lens[rows], kind="stable")
    for a in range(0, len(order), 4096):
        r, c = rows[order[a:a + 4096]], cols[order[a:a + 4096]]
        out[r, c] = np.minimum(1, kernel_pairs(w.rows(r, -2), zc[c]) / own[c]) ** POWER
    if cut:
        out[out < FLOOR] = 0
    return out


class Model:
    """Landmarks, weights per landmark, offset and the calibration of document margins."""

    def __init__(self, marks: list[str], alpha: np.ndarray, bias: float, platt: tuple[float, float]):
        self.marks, self.alpha, self.bias, self.platt = marks, alpha, bias, platt
        self.cache: dict[str, np.ndarray | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def learn_words(self, words: set[str]) -> None:
        """Kernel rows of words not yet in the cache (None: no landmark responds)."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        for a in range(0, len(new), 50_000):
            part = new[a:a + 50_000]
            self.cache.update(dict.fromkeys(part))
            all_pieces = ((p, w) for w in part for p in windows(w))
            while pieces := list(islice(all_pieces, PIECES)):        # a very long word has as many as letters
                k = kernel([p for p, _ in pieces], self.marks)
                for r in np.flatnonzero(k.any(axis=1)):
                    w = pieces[r][1]
                    old = self.cache[w]
                    self.cache[w] = k[r] if old is None else np.maximum(old, k[r])

    def features(self, sents: list[list[list[str]]]) -> list[np.ndarray]:
        """Per text the kernel rows of its responding sentences."""
        need = {w for s in sents for words in s for w in words}
        self.learn_words(need)
        get, out = self.cache.__getitem__, []
        for s in sents:
            rows = []
            for words in s:
                hit = [v for v in map(get, words) if v is not None]
                if hit:
                    rows.append(hit[0] if len(hit) == 1 else np.max(hit, axis=0))
            out.append(np.array(rows, np.float32).reshape(len(rows), len(self.marks)))
        return out

    def margins(self, feats: list[np.ndarray]) -> np.ndarray:
        return np.array([max(self.bias, float((f @ self.alpha).max()) + self.bias) if len(f) else self.bias for f in feats])

    def score(self, texts: list) -> np.ndarray:
        if not self.marks:
            return np.zeros(len(texts))
        out = []
        for a in range(0, len(texts), 512):
            m = self.margins(self.features([sentences(t) for t in texts[a:a + 512]]))
            out.append(1 / (1 + np.exp(np.clip(self.platt[0] * m + self.platt[1], -500, 500))))
        return np.concatenate(out) if out else np.zeros(0)


def choose_landmarks(texts: list[str], toxic: np.ndarray) -> list[str]:
    """Strings that separate toxic from clean documents, by greedy cover of the toxic ones."""
    def words_of(t):
        return {p for s in sentences(t) for w in s for p in windows(w)}

    def strings(ws):
        """The words, and their starts and ends of up to nine characters."""
        out = {w for w in ws if len(w) > P}
        for w in list(out):
            for n in range(P + 1, min(len(w), 10)):
                out.add(w[:n])
                out.add(w[-n:])
        return out

    n_tox, n_clean = int(toxic.sum()), int((~toxic).sum())
    least = max(3, int(0.004 * n_tox))
    docs = [int(i) for i in np.flatnonzero(toxic)]
    # counted by hash, so that only candidates are ever kept as strings
    hashes = lambda ws: np.fromiter(map(hash, strings(ws)), np.int64)
    seen, times = np.unique(np.concatenate([hashes(words_of(texts[i])) for i in docs]), return_counts=True)
    seen, times = seen[times >= least], times[times >= least]
    clean, memo = np.zeros(len(seen) + 1, np.int64), {}
    for i in np.flatnonzero(~toxic):
        hit = set()
        for w in words_of(texts[i]):
            at = memo.get(w)
            if at is None:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                h = hashes((w,))
                at = np.searchsorted(seen, h)
                at = memo[w] = tuple(at[seen[np.minimum(at, len(seen) - 1)] == h].tolist()) if len(seen) else ()
            hit.update(at)
        clean[list(hit)] += 1
    price = 10 * max(n_tox / max(1, n_clean), 0.1) * clean[:-1]
    worth = times - price >= least
    cost_of = dict(zip(seen[worth].tolist(), price[worth].tolist()))
    del seen, times, clean, memo, price
    canon: dict[str, str] = {}
    words, has, where = {}, {}, defaultdict(set)

    def known(ws):
        """The candidates among the strings of some words."""
        return {canon.setdefault(s, s) for s in strings(ws) if hash(s) in cost_of}

    for i in docs:
        words[i] = {w for w in words_of(texts[i]) if known((w,))}
        has[i] = known(words[i])
        for s in has[i]:
            where[s].add(i)
    cand = set(where)
    cost = {s: cost_of[hash(s)] for s in cand}
    weight = dict.fromkeys(docs, 1.0)             # halves each time a document is covered
    gain = {s: len(where[s]) - cost[s] for s in cand}
    marks: list[str] = []
    while gain and len(marks) < MAX_LANDMARKS:
        best = max(gain, key=lambda s: (gain[s], len(s), s))
        if gain[best] < least:
            break
        # the longest form of it that says about the same
        best = max((s for s in gain if best in s and gain[s] >= 0.95 * gain[best]), key=lambda s: (len(s), gain[s], s))
        marks.append(best)
        for i in list(where[best]):               # its words are explained: they count no more
            words[i] = {w for w in words[i] if best not in w}
            new = known(words[i]).difference(marks)
            for s in has[i]:
                gain[s] -= weight[i] / 2 if s in new else weight[i]
            for s in has[i] - new:
                where[s].discard(i)
            has[i], weight[i] = new, weight[i] / 2
        del gain[best]
        for i in docs:
            has[i].discard(best)
    return marks


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-2) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    ridge = reg * np.eye(xb.shape[1])
    ridge[-1, -1] = 1e-8
    for _ in range(30):
        act = y * (xb @ w) < 1
        xa = xb[act] * weight[act, None]
        new = np.linalg.solve(xb[act].T @ xa + ridge, xa.T @ y[act])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def fit_platt(m: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """P(toxic) = 1 / (1 + exp(a m + b)) by weighted maximum likelihood with soft targets."""
    n1, n0 = float(weight[toxic].sum()), float(weight[~toxic].sum())
    t = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones_like(m)], 1)
    v = np.array([-1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(x @ v, -30, 30)))
        grad = x.T @ (weight * (t - p))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        v = v - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(v[0]), float(v[1])


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Train on labelled documents; ``weight`` restores the class shares of all labels."""
    marks = choose_landmarks(texts, toxic) if toxic.any() and not toxic.all() else []
    empty = Model(marks, np.zeros(len(marks)), 0.0, (0.0, 0.0))
    if not marks:
        return empty
    kmm = kernel(marks, marks, cut=False).astype(float)
    vals, vecs = np.linalg.eigh((kmm + kmm.T) / 2)
    half = vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-2))) @ vecs.T       # K_mm^(-1/2)
    feats = []
    for a in range(0, len(texts), 512):
        feats += empty.features([sentences(t) for t in texts[a:a + 512]])
    empty.cache.clear()
    zero = np.zeros((1, len(marks)), np.float32)
    neg = np.unique(np.vstack([zero] + [f for f, t in zip(feats, toxic) if not t and len(f)]), axis=0)
    model = empty
    response = np.ones(len(marks))
    for step in range(3):
        pos = []
        for f in (f for f, t in zip(feats, toxic) if t and len(f)):
            on = f.max(axis=1) >= 0.8 if not step else f @ response + model.bias > 0
            pos.append(f[on] if on.any() else f[[np.argmax(f @ response)]])
        pos = np.vstack([zero, *pos])
        pos = pos[pos.any(axis=1)]
        x = np.vstack([pos, neg]) @ half
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        w = np.r_[np.full(len(pos), len(neg) / max(1, len(pos))), np.ones(len(neg))]
        v, bias = fit_svm(x, y, np.minimum(w, 10.0))
        response = half @ v
        model = Model(marks, response.astype(np.float32), bias, (0.0, 0.0))
    model.platt = fit_platt(model.margins(feats), toxic, weight)
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    counts = {r[0]: r[1] for r in lab.groupBy((F.col("toxic") > 0)).count().collect()}
    rows = []
    for want, most, part in ((True, TOXIC_ROWS, 0.4), (False, CLEAN_ROWS, 0.6)):
        got = sample_texts(docs, lab.where((F.col("toxic") > 0) == want), most, int(SAMPLE_CHARS * part))
        rows += [(k, t, want) for k, t in got]
    toxic = np.array([r[2] for r in rows], bool)
    share = {w: counts.get(w, 0) / max(1, int((toxic == w).sum())) for w in (True, False)}
    return fit([r[1] for r in rows], toxic, np.where(toxic, share[True], share[False]) if rows else np.zeros(0))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic; every column passes through unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(batch.column("text").to_pylist())
            yield batch.filter(pa.array(s < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
