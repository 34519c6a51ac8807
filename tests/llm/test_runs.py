"""Periodic runs against a plain definition."""

import hashlib
import random
import re
import time
import zlib

import pytest

from otgraph.llm.runs import document_runs, periodic_runs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_runs(w):
    """All stretches of equal words q apart, by the definition; smallest period only."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)                   # ascending q: the smallest stays
            i = j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain(text, doc_id, change=True):
    w = WORD.findall((text or "").encode())
    n = len(w)
    if change and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    return (len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest())


def random_text(rng):
    voc = ["a", "b", "c", "é", "dd"][:rng.randrange(1, 6)]
    parts = []
    for _ in range(rng.randrange(0, 6)):
        unit = [rng.choice(voc) for _ in range(rng.randrange(1, 12))]
        parts += unit * rng.randrange(1, 9) + unit[:rng.randrange(len(unit))] if rng.random() < .7 else unit
    return "".join(x + rng.choice([" ", "\n", "\t ", "\v", "\f\r"]) for x in parts)


def test_runs_equal_the_definition():
    rng = random.Random(3)
    for _ in range(60):
        texts = [random_text(rng) for _ in range(rng.randrange(1, 30))]
        ids = [rng.choice([None, rng.randrange(200)]) for _ in texts]
        assert document_runs([t.encode() for t in texts], ids) == [plain(t, d) for t, d in zip(texts, ids)]


def test_appended_in_small_pieces(monkeypatch):
    from otgraph.llm import runs
    monkeypatch.setattr(runs, "PIECE_WORDS", 3)
    monkeypatch.setattr(runs, "PIECE_BYTES", 5)
    rng = random.Random(4)
    for _ in range(15):
        texts = [random_text(rng) for _ in range(5)]
        assert document_runs([t.encode() for t in texts], [None] * 5) == [plain(t, None) for t in texts]


def test_equal_hashes_only_propose(monkeypatch):
    from otgraph.llm import runs
    monkeypatch.setattr(runs, "mix", lambda h: h * 0 + 7)           # every window equals its catcher
    rng = random.Random(5)
    for _ in range(15):
        texts = [random_text(rng) for _ in range(4)]
        assert document_runs([t.encode() for t in texts], [None] * 4) == [plain(t, None) for t in texts]


def test_long_texts_in_bounded_time():
    t0 = time.time()
    rng = random.Random(6)
    words = ["w%d" % rng.randrange(5000) for _ in range(300_000)]
    n, start, length, period, milli, _, _ = document_runs([" ".join(words[:1000] + words[1000:21_000] * 12).encode()], [None])[0]
    assert (start, period, length) == (1000, 20_000, 240_000) and milli == 12_000
    assert document_runs([b"x " * 1_000_000], [None])[0][:5] == (1, 0, 1_000_000, 1, 1_000_000_000)
    assert document_runs([b"y" * 5_000_000], [None])[0][0] == 0
    assert time.time() - t0 < 60


def test_periodic_runs_of_a_table(spark, clash):
    rng = random.Random(7)
    rows = [(i, random_text(rng)) for i in range(300)]
    rows += [(None, "a " * 9), (700, None), (701, ""), (702, " \n"), (700, None), (3, rows[3][1]), (704, "z z z z z"), (705, "z " * 6)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).withColumnRenamed("n", "length")
    got = sorted((tuple(r) for r in periodic_runs(df).collect()), key=str)
    assert got == sorted(((d, *plain(t, d)) for d, t in rows), key=str)
    assert periodic_runs(df.limit(0)).count() == 0
    assert periodic_runs(df, change=None).where("doc_id = 705").first()["n_runs"] == 1


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_on_the_given_table(spark, sf):
    from otgraph.llm.queries import QUERIES
    docs = [r for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect() if len(r["text"] or "") < 6000]
    want = {r["doc_id"]: plain(r["text"], r["doc_id"]) for r in docs}
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_runs"](spark, f"/root/testdata/{sf}").collect()}
    assert {d: got[d] for d in want} == want
