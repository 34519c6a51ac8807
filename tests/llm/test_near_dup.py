import random
import re

from otgraph.llm import near_dup as N


def _set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 3 else frozenset(tuple(w[i:i + 3]) for i in range(len(w) - 2))


def _rows():
    rng = random.Random(5)
    voc = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(14):
        t = [rng.choice(voc) for _ in range(rng.choice([2, 5, 30, 80, 200]))]
        for _ in range(rng.randrange(1, 7)):
            u = list(t)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                u[rng.randrange(len(u))] = rng.choice(voc)
            rows.append((len(rows) * 3 % 97 + len(rows) * 100, " ".join(u).title() if rng.random() < .3 else "  ".join(u)))
    rows += [(100000, None), (100001, ""), (100002, " \n "), (100003, "one"), (100004, "ONE"), rows[3], (None, "null id text here too"),
             (None, "null id text here too")]
    p = [rng.choice(voc) for _ in range(60)]
    rows += [(200000 + i, " ".join(p + [rng.choice(voc) for _ in range(50)])) for i in range(12)]      # a shared passage
    for i in range(40):                                                                             # a group of near copies
        u = list(p)
        u[rng.randrange(60)] = rng.choice(voc)
        rows.append((300000 + i, " ".join(u)))
    return rows


def _components(rows):
    sets = [_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_matches_brute_force(spark, clash, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)          # several blocks per bucket
    rows = _rows()
    sets, root = _components(rows)
    ids = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            ids[r] = min(d, ids.get(r, d))
    want = sorted(((d, len(s), c, d == c) for (d, _), s, r in zip(rows, sets, root) for c in [ids.get(r) if s else d]), key=str)
    df = clash(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    got = sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)
    assert got == want
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(root))


def test_masked_keys_guarantee_the_radius():
    rng = random.Random(1)
    import numpy as np
    for _ in range(200):
        a = np.array([rng.randrange(1 << 16) for _ in range(40)], np.uint16)
        b = a.copy()
        for i in rng.sample(range(40), N.RADIUS):
            b[i] ^= 1 + rng.randrange(100)
        assert set(N.masked_keys(a)[0]) & set(N.masked_keys(b)[0])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0 and N.drop_near_duplicates(df).count() == 0


def test_pairs_of_a_group_are_no_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 24)                       # several blocks per bucket, in both searches
    monkeypatch.setattr(N, "BLOCK_VALUES", 4000, raising=False)
    rng = random.Random(8)
    voc = [f"w{i}" for i in range(5000)]
    p = rng.sample(voc, 400)
    rows = []
    for i in range(72):                                       # most of the pairs at similarities just below the limit
        u = u if i % 6 == 5 else list(p)                      # every sixth is linked to the one before
        for j in rng.sample(range(3, 397, 6), 1 if i % 6 == 5 else 7):
            u[j] = rng.choice(voc)
        rows.append((i, " ".join(u)))
    made = {}

    def spy(df, kind, f=N.written):
        out = f(df, kind)
        made[kind] = made.get(kind, 0) + out.count()
        return out

    monkeypatch.setattr(N, "written", spy)
    sets, root = _components(rows)
    low = {r: min(d for (d, _), x in zip(rows, root) if x == r) for r in root}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: (len(s), low[r]) for (d, _), s, r in zip(rows, sets, root)}
    assert 1 < len(set(root)) < len(rows) and made["nd-more"] <= len(rows)
