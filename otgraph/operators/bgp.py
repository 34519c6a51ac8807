"""Graph-pattern queries over a triple DataFrame.

A pattern is a tuple ``(s, p, o)``; a term starting with ``?`` is a variable, anything else a
constant matched on the lexical form (so an object can join a subject). Each pattern becomes a
filtered projection of the triples; patterns are joined on their shared variables, optional
groups are left-joined, filters are Spark SQL expressions over the variable names. A pattern
that shares no variable with the rest would need a cartesian product and is rejected.
SPARQL text is not parsed; this is the builder a Spark user calls.

With ``stats`` (``predicate_stats``, collected once per graph) patterns that share a subject are one star: one scan
and one aggregation per subject instead of a scan and a join per pattern. Predicates of which a subject may
have more than ``STAR_MOST`` objects stay joins, so no subject's values pile up in a row. Stars and patterns are
joined in order of the rows the counts let expect.

A predicate may be a ``Path(predicate, "+" or "*")``: it is matched after the other patterns, from whichever end is
bound (a constant, or the values the other patterns leave; of two bound ends the smaller), and never lists the pairs
of the whole graph unless both ends are free.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otgraph.operators.graph import property_path

#: Objects of one subject and predicate that a star may hold in a row.
STAR_MOST = 16
#: Triples that one task of an aggregation by subject holds.
TASK_ROWS = 250_000


class Path(NamedTuple):
    """One or more (``+``) or any number (``*``) of hops along a predicate."""

    predicate: str
    mode: str = "+"


class Stat(NamedTuple):
    """Of one predicate: triples, distinct subjects and objects (about), and the most objects of a subject."""

    rows: int
    subjects: int
    objects: int
    most: int


Pattern = tuple[str, str | Path, str]
Stats = dict[str, Stat]


def predicate_stats(triples: DataFrame, patterns: Sequence[Pattern] | None = None) -> Stats:
    """Counts per predicate: of all, or of those that ``patterns`` name."""
    if patterns is not None:
        triples = triples.where(F.col("p").isin(sorted({p for _, p, _ in patterns if isinstance(p, str) and not isinstance(p, Path) and not _is_var(p)})))
    objects = {r["p"]: r for r in triples.groupBy("p").agg(F.count("*").alias("rows"), F.approx_count_distinct("o").alias("objects")).collect()}
    n = _parts(triples, sum(r["rows"] for r in objects.values()))
    # subjects by their hash, in parts of bounded size: counts for planning need not tell two of 2^64 apart
    keyed = triples.select("p", F.xxhash64("s").alias("s")).repartition(n, "s")
    subjects = keyed.groupBy("p", "s").agg(F.count("*").alias("n")).groupBy("p").agg(F.count("*").alias("subjects"), F.max("n").alias("most"))
    return {r["p"]: Stat(objects[r["p"]]["rows"], r["subjects"], objects[r["p"]]["objects"], r["most"])
            for r in subjects.collect() if r["p"] in objects}            # a row per predicate


def _parts(df: DataFrame, rows: float) -> int:
    """Partitions for an aggregation by subject: as many as shuffles have, or one per ``TASK_ROWS``."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(rows // TASK_ROWS) + 1)


def _is_var(t: str) -> bool:
    return isinstance(t, str) and t.startswith("?")


def _vname(t: str) -> str:
    return t[1:]


def match_pattern(triples: DataFrame, pattern: Pattern) -> DataFrame:
    """Bindings of one pattern: one column per distinct variable."""
    df = triples
    cols: dict[str, str] = {}
    for pos, term in zip(("s", "p", "o"), pattern):
        if _is_var(term):
            name = _vname(term)
            if name in cols:
                df = df.filter(F.col(pos) == F.col(cols[name]))
            else:
                cols[name] = pos
        else:
            df = df.filter(F.col(pos) == F.lit(term))
    return df.select(*[F.col(pos).alias(name) for name, pos in cols.items()])


def _n_consts(p: Pattern) -> int:
    return sum(0 if _is_var(t) else 1 for t in p)


def match_star(triples: DataFrame, subject: str, parts: Sequence[tuple[str, str]], rows: float = 0) -> DataFrame:
    """Bindings of patterns (subject, p, o) with constant predicates: one scan, one aggregation per subject. ``rows``:
    triples to expect of them."""
    preds = sorted({p for p, _ in parts})
    fixed = {p: sorted({o for q, o in parts if q == p}) for p in preds if not any(_is_var(o) for q, o in parts if q == p)}
    wanted = F.col("p").isin([p for p in preds if p not in fixed])
    for p, objects in fixed.items():                     # of a predicate with constant objects only, no other triple counts
        wanted = wanted | ((F.col("p") == F.lit(p)) & F.col("o").isin(objects))
    df = triples.where(wanted & F.col("s").isNotNull())
    if not _is_var(subject):
        df = df.where(F.col("s") == F.lit(subject))
    held = df.repartition(_parts(df, rows), "s").groupBy("s").agg(*[F.collect_list(F.when(F.col("p") == p, F.struct("o"))).alias(f"_o{i}") for i, p in enumerate(preds)])
    held = held.where(" and ".join(f"size(_o{i}) > 0" for i in range(len(preds))))
    out, seen = held.withColumnRenamed("s", "_s"), {subject: "_s"}
    for k, (p, o) in enumerate(sorted(parts, key=lambda x: _is_var(x[1]))):          # constants first: they only thin out
        objects = F.col(f"_o{preds.index(p)}")
        if not _is_var(o) or o in seen:
            same = F.lit(o) if not _is_var(o) else F.col(seen[o])
            out = out.withColumn("_one", F.explode(F.filter(objects, lambda x: x["o"] == same))).drop("_one")
        else:
            out = out.withColumn(f"_v{k}", F.explode(objects)).withColumn(f"_v{k}", F.col(f"_v{k}")["o"])
            seen[o] = f"_v{k}"
    return out.select(*[F.col(c).alias(_vname(v)) for v, c in seen.items() if _is_var(v)])


def _expected(pattern: Pattern, stats: Stats) -> float:
    """Rows to expect of a pattern."""
    s, p, o = pattern
    if _is_var(p):
        return float(sum(x.rows for x in stats.values()))
    x = stats.get(p, Stat(0, 1, 1, 0))
    return x.rows / (1 if _is_var(s) else max(1, x.subjects)) / (1 if _is_var(o) else max(1, x.objects))


def _units(triples: DataFrame, patterns: Sequence[Pattern], stats: Stats) -> list[tuple[float, list[str], DataFrame]]:
    """(expected rows, variables, bindings) of the stars and of the patterns outside of them."""
    by: dict[str, list[Pattern]] = defaultdict(list)
    rest = []
    for pat in patterns:
        s, p, _ = pat
        if not _is_var(p) and stats.get(p, Stat(0, 0, 0, 0)).most <= STAR_MOST:
            by[s].append(pat)
        else:
            rest.append(pat)
    out = []
    for s, pats in by.items():
        if len(pats) == 1:
            rest += pats
            continue
        names = list(dict.fromkeys(v for p in pats for v in match_pattern_vars(p)))
        out.append((min(_expected(p, stats) for p in pats), names, match_star(triples, s, [(p, o) for _, p, o in pats], sum(stats[p].rows for p in {p for _, p, _ in pats} if p in stats))))
    return out + [(_expected(p, stats), match_pattern_vars(p), match_pattern(triples, p)) for p in rest]


def _joined(units: list[tuple[float, list[str], DataFrame]]) -> DataFrame:
    """All units joined, the least expected rows first, each to what it shares a variable with."""
    todo = sorted(units, key=lambda u: u[0])
    _, names, result = todo.pop(0)
    names = list(names)
    while todo:
        i = next((i for i, u in enumerate(todo) if set(u[1]) & set(names)), None)
        if i is None:
            raise ValueError("patterns are not connected; a cartesian product is not built")
        _, more, df = todo.pop(i)
        result = result.join(df, on=[v for v in more if v in names], how="inner")
        names += [v for v in more if v not in names]
    return result


def match_path(triples: DataFrame, pattern: Pattern, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """Bindings of a pattern with a ``Path``, joined to the bindings that know its subject (``left``) and its object
    (``right``; may be the same frame)."""
    s, path, o = pattern

    def side(term: str, known: DataFrame | None) -> DataFrame | None:
        """The nodes of an end that is bound."""
        if not _is_var(term):
            return triples.sparkSession.createDataFrame([(term,)], "node string")
        return None if known is None else known.select(F.col(_vname(term)).alias("node")).distinct()

    start, end = side(s, left), side(o, right)
    if start is not None and end is not None:            # walk from the smaller end
        n = [1 if not _is_var(t) else df.count() for t, df in ((s, start), (o, end))]
        start, end = (start, None) if n[0] <= n[1] else (None, end)
    pairs = property_path(triples, path.predicate, path.mode, start, end)
    for c, term in (("x", s), ("y", o)):
        if not _is_var(term):
            pairs = pairs.where(F.col(c) == F.lit(term))
    if s == o:
        pairs = pairs.where("x = y").drop("y")
    pairs = pairs.select(*[F.col(c).alias(_vname(t)) for c, t in (("x", s), ("y", o)) if c in pairs.columns and _is_var(t)])
    out = pairs
    for known in [df for i, df in enumerate((left, right)) if df is not None and not (i and df is left)]:
        shared = [c for c in out.columns if c in known.columns]
        if shared:
            out = known.join(out, on=shared, how="inner")
        else:                                            # both ends constant: all bindings or none
            out = known if not out.isEmpty() else known.limit(0)
    return out


def _groups(patterns: Sequence[Pattern]) -> list[list[Pattern]]:
    """Patterns that hang together by variables."""
    out: list[list[Pattern]] = []
    for p in patterns:
        mine = [g for g in out if any(set(match_pattern_vars(p)) & set(match_pattern_vars(q)) for q in g)]
        out = [g for g in out if g not in mine] + [[q for g in mine for q in g] + [p]]
    return out


def bgp_match(triples: DataFrame, patterns: Sequence[Pattern], stats: Stats | None = None) -> DataFrame:
    """Join the patterns on shared variables: by the counts of ``stats``, else most constrained first; paths last, those
    with a bound end first. A path may be what joins two groups of patterns."""
    paths = [p for p in patterns if isinstance(p[1], Path)]
    todo = sorted((p for p in patterns if not isinstance(p[1], Path)), key=lambda p: -_n_consts(p))
    if not todo and not paths:
        raise ValueError("no patterns")
    found = [_joined(_units(triples, g, stats)) if stats is not None else _in_order(triples, g)
             for g in (_groups(todo) if paths else [todo] if todo else [])]
    while paths:
        knows = lambda t: next((d for d in found if _is_var(t) and _vname(t) in d.columns), None)
        paths.sort(key=lambda p: -sum(not _is_var(t) or knows(t) is not None for t in (p[0], p[2])))
        path = paths.pop(0)
        left, right = knows(path[0]), knows(path[2])
        if left is None and right is None and not match_pattern_vars(path):
            left = right = found[0] if found else None   # two constants: a condition on the rest
        found = [match_path(triples, path, left, right)] + [d for d in found if d is not left and d is not right]
    if len(found) > 1:
        raise ValueError("patterns are not connected; a cartesian product is not built")
    return found[0]


def _in_order(triples: DataFrame, todo: list[Pattern]) -> DataFrame:
    todo = list(todo)
    first = todo.pop(0)
    result = match_pattern(triples, first)
    while todo:
        for i, pat in enumerate(todo):
            shared = [v for v in match_pattern_vars(pat) if v in result.columns]
            if shared:
                result = result.join(match_pattern(triples, pat), on=shared, how="inner")
                todo.pop(i)
                break
        else:
            raise ValueError("patterns are not connected; a cartesian product is not built")
    return result


def match_pattern_vars(p: Pattern) -> list[str]:
    out: list[str] = []
    for t in p:
        if _is_var(t) and _vname(t) not in out:
            out.append(_vname(t))
    return out


def _as_col(f) -> Column:
    return F.expr(f) if isinstance(f, str) else f


def _order(v) -> Column:
    """A sort key by variable name; a leading ``-`` sorts descending."""
    if isinstance(v, Column):
        return v
    down, name = v.startswith("-"), v.lstrip("-")
    c = F.col(_vname(name) if _is_var(name) else name)
    return c.desc() if down else c.asc()


def bgp_select(triples: DataFrame, patterns: Sequence[Pattern] = (),
               optional: Sequence[Sequence[Pattern]] = (), filters: Sequence = (),
               union: Sequence[Sequence[Pattern]] = (), select: Sequence[str] | None = None,
               distinct: bool = False, order_by: Sequence[str] | None = None,
               limit: int | None = None, group_by: Sequence[str] | None = None,
               aggregates: dict[str, Column | str] | None = None,
               having: Column | str | None = None, stats: Stats | None = None) -> DataFrame:
    """SELECT over basic graph patterns.

    ``union`` alternatives are matched separately and stacked by variable name, then joined to
    ``patterns`` (or used alone). ``optional`` groups are left joins on shared variables;
    ``filters`` apply after the optional groups, like SPARQL FILTER at group level. With
    ``aggregates`` (output name → aggregate) the bindings are grouped by ``group_by`` and ``having``
    filters the groups. ``stats`` (``predicate_stats``) orders the joins and joins stars in one scan.
    """
    result: DataFrame | None = bgp_match(triples, patterns, stats) if patterns else None
    if union:
        alts = [bgp_match(triples, g, stats) for g in union]
        u = alts[0]
        for a in alts[1:]:
            u = u.unionByName(a, allowMissingColumns=True)
        if result is None:
            result = u
        else:
            shared = [c for c in u.columns if c in result.columns]
            if not shared:
                raise ValueError("UNION block shares no variable with the patterns")
            result = result.join(u, on=shared, how="inner")
    if result is None:
        raise ValueError("nothing to match")
    for group in optional:
        g = bgp_match(triples, group, stats)
        shared = [c for c in g.columns if c in result.columns]
        if not shared:
            raise ValueError("OPTIONAL group shares no variable with the patterns")
        result = result.join(g, on=shared, how="left")
    for f in filters:
        result = result.filter(_as_col(f))
    if aggregates:
        keys = [_vname(v) if _is_var(v) else v for v in group_by or ()]
        result = result.groupBy(*keys).agg(*[_as_col(a).alias(n) for n, a in aggregates.items()])
        if having is not None:
            result = result.filter(_as_col(having))
    if select:
        result = result.select(*[_vname(v) if _is_var(v) else v for v in select])
    if distinct:
        result = result.distinct()
    if order_by:
        result = result.orderBy(*[_order(v) for v in order_by])
    if limit is not None:
        result = result.limit(int(limit))
    return result


def bgp_construct(triples: DataFrame, patterns: Sequence[Pattern],
                  template: Sequence[Pattern]) -> DataFrame:
    """CONSTRUCT (G9): each binding fills the template; the result is a triple set."""
    b = bgp_match(triples, patterns)

    def term(t: str) -> Column:
        return F.col(_vname(t)) if _is_var(t) else F.lit(t)

    arr = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o"))
                    for s, p, o in template])
    out = b.select(F.inline(arr))
    return out.filter(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull()) \
        .distinct()


def bgp_ask(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """ASK (G10): one row, ``ask`` true when the patterns have a solution."""
    return bgp_match(triples, patterns).limit(1).agg((F.count(F.lit(1)) > 0).alias("ask"))
