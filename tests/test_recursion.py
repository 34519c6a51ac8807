"""Rounds that follow the logarithm of the depth: compared with plain walks on random graphs."""

import random
from collections import deque

import pytest

from otgraph.operators import recursion as R


def plain(edges, seeds, start=0, max_depth=None):
    out = {}
    nxt = {}
    for a, b in edges:
        nxt.setdefault(a, set()).add(b)
    for root in {r for r, _ in seeds}:
        depth = {n: start for r, n in seeds if r == root}
        queue = deque(depth)
        while queue:
            n = queue.popleft()
            for m in nxt.get(n, ()):
                if m not in depth and (max_depth is None or depth[n] < max_depth):
                    depth[m] = depth[n] + 1
                    queue.append(m)
        out.update({(root, n): d for n, d in depth.items()})
    return out


def _graph(rng, n, chains=True):
    edges = {(str(rng.randrange(n)), str(rng.randrange(n))) for _ in range(rng.randrange(1, 2 * n))}
    if chains:                                           # long links, some closing to cycles, some hanging on others
        for c in range(3):
            names = [f"c{c}.{i}" for i in range(rng.randrange(2, 30))]
            edges |= set(zip(names, names[1:]))
            if rng.random() < .5:
                edges.add((names[-1], names[0]))
            if rng.random() < .7:
                edges.add((str(rng.randrange(n)), names[rng.randrange(len(names)) // 2]))
            edges.add((names[-1], str(rng.randrange(n)))) if rng.random() < .5 else None
    return sorted(edges)


def _pairs(df):
    rows = [((r["root"], r["node"]), r["depth"]) for r in df.collect()]
    assert len(rows) == len({k for k, _ in rows})
    return dict(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_reachable_equals_a_plain_walk(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(R, "PLAIN_ROUNDS", [0, 1, 2, 4][seed])
    edges = _graph(rng, 12)
    seeds = sorted({(f"r{rng.randrange(3)}", rng.choice(rng.choice(edges))) for _ in range(4)})
    e = spark.createDataFrame(edges + [(None, "x"), ("x", None)], "src string, dst string")
    s = spark.createDataFrame(seeds, "root string, node string")
    assert _pairs(R.reachable(e, s)) == plain(edges, seeds)
    assert _pairs(R.reachable(e, s, max_depth=9)) == plain(edges, seeds, max_depth=9)


def test_closure_equals_all_walks(spark):
    rng = random.Random(9)
    for n, chains in ((7, True),):
        edges = _graph(rng, n, chains)
        nodes = {a for a, _ in edges}
        step = {}
        for a, b in edges:
            step.setdefault(a, set()).add(b)
        want = {}
        for a in nodes:                                  # at least one step: start from the neighbours
            want.update(plain(edges, [(a, b) for b in step[a]], start=1))
        assert _pairs(R.closure(spark.createDataFrame(edges, "src string, dst string"))) == want
    assert R.closure(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_walk_up_equals_a_plain_walk(spark):
    rng = random.Random(4)
    for _ in range(1):
        parent = {str(i): rng.choice([None, *map(str, range(25))]) for i in range(20)}
        parent.update({f"d{i}": f"d{i + 1}" for i in range(17)})
        df = spark.createDataFrame(list(parent.items()), "node string, parent string")
        want = {}
        for node in {*parent, *(p for p in parent.values() if p)}:
            path, at = [], parent.get(node)
            while at is not None and at not in path and not (path and at == node):
                path.append(at)
                at = parent.get(at)
            want[node] = path[::-1]
        assert {r["node"]: r["path"] for r in R.walk_up(df).collect()} == want
        assert {r["node"]: r["path"] for r in R.walk_up(df, max_depth=2).collect()} == {n: p[-3:] for n, p in want.items()}


def test_long_chains_take_few_rounds(spark):
    n = 10_000
    chain = spark.range(n).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst")
    rounds = []
    got = R.reachable(chain, spark.createDataFrame([("f", "0")], "root string, node string"), rounds=rounds)
    assert len(rounds) <= 15
    row = got.selectExpr("count(*)", "max(depth)", "sum(abs(depth - cast(node as long)))").first()
    assert tuple(row) == (n + 1, n, 0)
    rounds = []
    up = R.walk_up(spark.range(200).selectExpr("cast(id as string) as node", "cast(id + 1 as string) as parent"), rounds=rounds)
    assert len(rounds) <= 9 and tuple(up.selectExpr("max(size(path))", "count(*)").first()) == (200, 201)
    rounds = []
    pairs = R.closure(spark.range(100).selectExpr("cast(id as string) as src", "cast(id + 1 as string) as dst"), rounds=rounds)
    assert len(rounds) <= 8 and pairs.count() == 100 * 101 // 2
