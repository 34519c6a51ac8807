"""Graph-pattern builder behaviour."""

import pytest

from otgraph.operators import bgp as B


def _g(spark):
    return spark.createDataFrame([
        ("a", "type", "T"), ("b", "type", "T"), ("a", "knows", "b"), ("b", "knows", "b"),
        ("a", "age", "30"), ("x", "label", "X")], "s string, p string, o string")


def test_select_optional_filter(spark):
    g = _g(spark)
    out = B.bgp_select(g, [("?x", "type", "T")], optional=[[("?x", "age", "?age")]],
                       filters=["age IS NULL OR CAST(age AS INT) > 10"], select=["?x", "?age"])
    assert sorted(tuple(r) for r in out.collect()) == [("a", "30"), ("b", None)]


def test_repeated_variable_in_one_pattern(spark):
    out = B.bgp_select(_g(spark), [("?x", "knows", "?x")])
    assert [r.x for r in out.collect()] == ["b"]


def test_disconnected_patterns_are_rejected(spark):
    with pytest.raises(ValueError):
        B.bgp_match(_g(spark), [("?x", "type", "T"), ("?y", "label", "X")])


def test_construct_and_ask(spark):
    g = _g(spark)
    c = B.bgp_construct(g, [("?x", "knows", "?y")], [("?y", "knownBy", "?x")])
    assert sorted(tuple(r) for r in c.collect()) == [("b", "knownBy", "a"), ("b", "knownBy", "b")]
    assert B.bgp_ask(g, [("?x", "label", "X")]).collect()[0].ask is True
    assert B.bgp_ask(g, [("?x", "label", "Y")]).collect()[0].ask is False


def test_random_patterns_against_brute_force(spark):
    import itertools
    import random
    rnd = random.Random(4)
    nodes, preds = [f"n{i}" for i in range(8)], ["p", "q", "r"]
    triples = {(rnd.choice(nodes), rnd.choice(preds), rnd.choice(nodes)) for _ in range(40)}
    g = spark.createDataFrame(sorted(triples), "s string, p string, o string")
    # ?x p ?y . ?y q ?z  OPTIONAL { ?z r ?w }  FILTER (x != z)
    got = [tuple(r) for r in B.bgp_select(
        g, [("?x", "p", "?y"), ("?y", "q", "?z")], optional=[[("?z", "r", "?w")]],
        filters=["x != z"], select=["?x", "?y", "?z", "?w"]).collect()]
    want = []
    for (x, p1, y), (y2, p2, z) in itertools.product(triples, triples):
        if p1 == "p" and p2 == "q" and y == y2 and x != z:
            ws = [o for s, p3, o in triples if s == z and p3 == "r"]
            want += [(x, y, z, w) for w in ws] or [(x, y, z, None)]
    def key(t):
        return tuple("" if v is None else v for v in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def _random_graph(spark, rng, n=60):
    names = [f"n{i}" for i in range(8)]
    rows = [(rng.choice(names), rng.choice(["p", "q", "r", "t"]), rng.choice(names + ["x", "y", None])) for _ in range(n)]
    return spark.createDataFrame(rows, "s string, p string, o string")


PATTERNS = [
    [("?a", "p", "?b"), ("?a", "q", "?c"), ("?a", "r", "x")],
    [("?a", "p", "?b"), ("?a", "q", "?b"), ("?b", "t", "?d"), ("?b", "p", "?e"), ("?d", "?any", "?f")],
    [("?a", "p", "?a"), ("?a", "q", "?c")],
    [("n1", "p", "?b"), ("n1", "q", "?c"), ("?b", "t", "?c")],
    [("?a", "p", "?b"), ("?a", "p", "?c"), ("?a", "missing", "?d")],
    [("?a", "p", "x"), ("?a", "q", "y")],
]


def test_stars_and_join_order_give_the_same(spark, monkeypatch):
    import random
    rng = random.Random(2)
    g = _random_graph(spark, rng)
    stats = B.predicate_stats(g)
    for most in (16, 2):                                 # with 2 some predicates stay joins
        monkeypatch.setattr(B, "STAR_MOST", most)
        for pats in PATTERNS:
            plain, star = B.bgp_match(g, pats), B.bgp_match(g, pats, stats)
            cols = sorted(plain.columns)
            assert sorted(star.columns) == cols
            rows = [sorted((tuple(r) for r in df.select(*cols).collect()), key=str) for df in (plain, star)]
            assert rows[0] == rows[1], (most, pats)
    with pytest.raises(ValueError):
        B.bgp_match(g, [("?x", "p", "?y"), ("?z", "q", "x")], stats)


def test_one_scan_per_star(spark, tmp_path):
    _random_graph(spark, __import__("random").Random(3)).write.parquet(str(tmp_path / "g"))
    g = spark.read.parquet(str(tmp_path / "g"))
    pats = [("?a", "p", "?b"), ("?a", "q", "?c"), ("?a", "r", "?d"), ("?b", "t", "?e"), ("?b", "p", "?f")]
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    assert scans(B.bgp_match(g, pats)) == 5
    assert scans(B.bgp_match(g, pats, B.predicate_stats(g, pats))) == 2


def test_stars_aggregate_matching_triples_in_parts_of_bounded_size(spark):
    g = spark.createDataFrame([("a", "p", "x"), ("a", "q", "1"), ("b", "p", "y"), ("b", "q", "2")], "s string, p string, o string")
    rows = 40 * B.TASK_ROWS
    star = B.match_star(g, "?a", [("p", "x"), ("q", "?c")], rows)
    plan = star._jdf.queryExecution().optimizedPlan().toString()
    assert "= x)" in plan.split("RepartitionByExpression")[1]               # types that the star does not ask for are not dealt
    assert star._jdf.queryExecution().analyzed().toString().count("RepartitionByExpression [s#") == 1 and ", 41" in plan
    assert [tuple(r) for r in star.select("a", "c").collect()] == [("a", "1")]
    assert B.predicate_stats(g) == {"p": B.Stat(2, 2, 2, 1), "q": B.Stat(2, 2, 2, 1)}


def _reach(rows, pred, mode):
    edges = {(s, o) for s, p, o in rows if p == pred and s and o}
    pairs = set(edges)
    while more := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
        pairs |= more
    return pairs | ({(x, x) for e in edges for x in e} if mode == "*" else set())


@pytest.mark.parametrize("mode", ["+", "*"])
def test_paths_with_bound_ends(spark, mode):
    import random
    g = _random_graph(spark, random.Random(4), 40).where("o is not null")
    rows = [tuple(r) for r in g.collect()]
    pairs, path = _reach(rows, "p", mode), B.Path("p", mode)
    zero = {("n1", "n1"), ("y", "y")} if mode == "*" else set()
    got = lambda pats, *c: sorted(map(tuple, B.bgp_match(g, pats).select(*c).distinct().collect()))
    assert got([("n1", path, "?y")], "y") == sorted({(b,) for a, b in pairs | zero if a == "n1"})
    assert got([("?x", path, "y")], "x") == sorted({(a,) for a, b in pairs | zero if b == "y"})
    q = {(s, o) for s, p, o in rows if p == "q" and s and o}
    star = pairs | {(x, x) for e in q for x in e} if mode == "*" else pairs
    assert got([("?a", "q", "?x"), ("?x", path, "?y")], "a", "x", "y") == sorted((a, x, y) for a, x in q for c, y in star if c == x)
    assert got([("?x", "q", "?b"), ("?x", path, "?y"), ("?y", "q", "?d")], "x", "y", "d") == sorted({(x, y, d) for x, _ in q for c, y in star if c == x for e, d in q if e == y})
    assert got([("?x", "q", "?y"), ("?x", path, "?y")], "x", "y") == sorted(q & star)
    both = [("?x", "q", "?y"), ("n1", path, "n2")]
    assert len(got(both, "x", "y")) == (len(q) if ("n1", "n2") in pairs else 0)
    assert got([("?x", path, "?y")], "x", "y") == sorted(pairs)
