"""The mix of sources: apportionment by its definition, targets, selection, texts."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from otgraph.llm import mixing as M

SF = "/root/testdata/sf0.01"


def plain_seats(claims, seats, most):
    got = [0] * len(claims)
    for _ in range(seats):
        open_ = [i for i in range(len(claims)) if claims[i] and got[i] < most[i]]
        if not open_:
            break
        got[max(open_, key=lambda i: (Fraction(claims[i]) / (2 * got[i] + 1), -i))] += 1
    return got


def test_highest_quotients():
    rng = random.Random(1)
    for _ in range(300):
        claims = [rng.choice([0, 1, 3, rng.randrange(1, 1000)]) for _ in range(rng.randrange(1, 9))]
        seats = rng.choice([0, 1, 5, rng.randrange(200)])
        most = [rng.choice([1, 10, 1000]) for _ in claims]
        assert M.sainte_lague(claims, seats, most) == plain_seats(claims, seats, most)
    big = M.sainte_lague([3 * 10**12, 10**12, 2 * 10**12], 6 * 10**11)
    assert big == [3 * 10**11, 10**11, 2 * 10**11]


def plain_targets(sizes):
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    out, full = [Fraction(0)] * len(sizes), set()
    while True:
        left = Fraction(3 * sum(sizes), 2) - sum(2 * sizes[i] for i in full)
        heavy = sum(w[i] for i in range(len(sizes)) if i not in full)
        out = [Fraction(2 * s) if i in full else left * w[i] / heavy for i, s in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if out[i] > 2 * sizes[i]}
        if not above:
            return out
        full |= above


def test_targets_stop_and_reshare():
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, rng.randrange(10**6)]) for _ in range(rng.randrange(1, 12))]
        got = M.targets(sizes)
        assert got == plain_targets(sizes) and sum(got) == Fraction(3 * sum(sizes), 2)
    assert M.targets([]) == [] and M.targets([0, 0]) == [0, 0]


def test_word_counts():
    texts = [b"", b" ", b"a", b" a\xc2\xa0b\tc\x0bd\x0c\re\n", b"x" * 9]
    assert M.count_words(texts).tolist() == [len(t.split()) for t in texts] and M.count_words([]).tolist() == []


def test_shards_selection_and_texts(spark, clash):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "B", "é", None, "a", "a"]), " ".join(f"w{j}" for j in range(rng.randrange(0, 200)))) for i in range(400)]
    rows += [(1000, "a", None), (1001, "zero", ""), (1002, "zero", " \n"), (None, "B", "x y z"), (5, rows[5][1], rows[5][2]), (1003, "a", "v " * 30_000)]
    df = clash(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    got = M.mix(df, block=16, shard_rows=40).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.source) for r in got) == Counter((d, len((t or "").split()), s) for d, s, t in rows)
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in got if r.source == s) for s in names]
    for s, size, goal in zip(names, sizes, plain_targets(sizes)):
        mine = [r for r in got if r.source == s]
        assert {(r.source_size, r.target) for r in mine} == {(size, float(goal))}
        assert abs(sum(r.taken for r in mine) - goal) <= 16 * (1 + len(mine) / 20)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = M.mix(df.repartition(7), block=16, shard_rows=40).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    words, text = Counter(), dict((d, (t or "").split()) for d, _, t in rows)
    for r in M.mixed_texts(df, block=16, shard_rows=40).collect():
        part = r.text.split(" ")
        assert part == text[r.doc_id][r.word:r.word + len(part)] and part
        words[r.doc_id] += len(part)
    assert words == Counter({d: n for d, n in _sums(got).items() if n})
    assert M.mix(df.limit(0)).count() == 0


def _sums(rows):
    out = defaultdict(int)
    for r in rows:
        out[r.doc_id] += r.taken
    return out


def test_counted_places_equal_listed_blocks(spark):
    rows = M.placed(spark.read.parquet(f"{SF}/documents.parquet"), block=7, shard_rows=25).collect()
    taken = Counter()
    for r in rows:
        n, q, extra = r.n_blocks, r.quota // r.n_blocks, r.quota % r.n_blocks
        chosen = {i for i in range(n) if ((i + 1) * extra + r.phase) // n > (i * extra + r.phase) // n}
        assert len(chosen) == extra
        taken[r.doc_id] += sum(q + ((r.first + x) // r.block in chosen) for x in range(r.size))
    got = M.mix(spark.read.parquet(f"{SF}/documents.parquet"), block=7, shard_rows=25).collect()
    assert _sums(got) == taken


def test_query_equals_sql(spark):
    _equal(spark, "op12_mixing", "sf0.001")


def _equal(spark, name, sf):
    import duckdb
    from otgraph.llm.queries import ORACLE_SQL, QUERIES
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    got = QUERIES[name](spark, f"/root/testdata/{sf}").toPandas()
    want = con.execute(ORACLE_SQL[name]).df()[list(got.columns)]
    assert len(got) and sorted(map(repr, got.itertuples(index=False))) == sorted(map(repr, want.itertuples(index=False)))
    assert np.array_equal(sorted(got.columns), sorted(want.columns))
