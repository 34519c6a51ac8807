"""Ranked search against the formula, term by term."""

import math
import random
import re
from collections import Counter

import numpy as np

from otgraph.llm import lexical as X

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted: dict = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, words in wanted.items():
        scored = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in words if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def _data(rng):
    voc = ["the", "The", "ÉTÉ", "été", "x1", "日本", "a", "b", "c", "q7", "zz", "Ω"]
    text = lambda n: "".join(rng.choice(voc) + rng.choice([" ", "-", "\n", ", ", "\x00", "_", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(0, 30))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(60)] + [docs[3], docs[3], (900, None), (901, ""), (902, "--"), (None, docs[3][1]), (903, "the " * 9000)]
    items = [(i, text(rng.randrange(1, 9))) for i in range(40)] + [(90, None), (91, ""), (92, "absent"), (None, "the q7"), (3, "q7 日本"), (0, docs[3][1])]
    return docs, items


def test_search_equals_the_formula(spark, clash, monkeypatch):
    docs, items = _data(random.Random(1))
    d = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    b = clash(spark.createDataFrame(items, "item_id long, text string"))
    want = plain(docs, items)
    got = lambda **k: sorted((tuple(r) for r in X.search(d, b, **k).collect()), key=str)
    assert got() == want
    assert got(block_terms=20) == want                                  # several item blocks
    assert got(top=3) == plain(docs, items, 3)
    assert X.search(d.limit(0), b).count() == 0 and X.search(d, b.limit(0)).count() == 0


def test_small_tiles_give_the_same(spark, monkeypatch):
    docs, items = _data(random.Random(2))
    rows = [(d, Counter(t.encode() for t in terms(t))) for d, t in docs]
    rows = [(d, c) for d, c in rows if c]
    block = X.Block(sorted({(i, t) for i, x in items for t in terms(x)}, key=str))
    total = sum(sum(c.values()) for _, c in rows)
    df = np.array([sum(t in c for _, c in rows) for t in block.slot], np.int64)
    weight = X.term_weights(df, len(rows))
    want = plain(docs, items)
    for doc_tile, item_tile, term_tile, exact in ((1, 1, 1, X.EXACT), (7, 3, 2, X.EXACT), (1000, 64, 2048, int(weight.max()) * X.IMPACT * 3 + 1)):
        monkeypatch.setattr(X, "ITEM_TILE", item_tile)
        monkeypatch.setattr(X, "TERM_TILE", term_tile)
        monkeypatch.setattr(X, "EXACT", exact)
        tiles, best = X.Tiles(block, weight), X.Best(len(block.ids), 10)
        assert all(len(t) <= max(1, (exact - 1) // (X.IMPACT * int(weight.max()))) for _, _, parts in tiles.tiles for t, _ in parts)
        for a in range(0, len(rows), doc_tile):
            some = rows[a:a + doc_tile]
            hit = [(k, block.slot[t], c[t]) for k, (_, c) in enumerate(some) for t in c if t in block.slot]
            row, slot, tf = np.array(hit, np.int64).reshape(-1, 3).T
            m = X.norms(np.array([sum(c.values()) for _, c in some]), len(rows), total)
            impact = (10**9 * tf // (1000 * tf + 8 * m[row])).astype(float)
            ids, none = np.array([d or 0 for d, _ in some]), np.array([int(d is None) for d, _ in some])
            for first, score in tiles.scores(len(some), row, slot, impact):
                best.add(first, score, ids, none)
        got = []
        for a, r in best.rows.items():
            rank = Counter()
            for i, s, no, d in r.T.tolist():
                rank[i] += 1
                got.append((block.ids[a + i], rank[i], None if no else d, s))
        assert sorted(got, key=str) == want


def test_terms_of_long_texts(monkeypatch):
    rng = random.Random(3)
    raw = "".join(rng.choice(["ab", " ", "É", "-", "Z9"]) for _ in range(5000)).encode()
    want = Counter(t.encode() for t in terms(raw.decode()))
    assert X.count_terms(raw) == want
    monkeypatch.setattr(X, "PIECE_BYTES", 7)
    assert X.count_terms(raw) == want and X.count_terms(b"") == Counter()


def test_norms_beyond_64_bits():
    n = np.array([1, 10**9, 2 * 10**9], np.int64)
    assert X.norms(n, 10**10, 10**13).tolist() == [10 + 90 * x * 10**10 // 10**13 for x in n.tolist()]


def test_query_equals_sql(spark):
    import duckdb
    from otgraph.llm.queries import ORACLE_SQL, QUERIES
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    got = QUERIES["op13_lexical"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLE_SQL["op13_lexical"]).fetchall()) != []
