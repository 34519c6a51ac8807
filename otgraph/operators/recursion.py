"""Iterative joins for reachability, closures and parent walks, in rounds that follow the logarithm of the depth.

* ``walk_up`` doubles paths: after round r every node holds its path of 2^r parents, and a round joins each path
  with the path of its tip.
* ``closure`` doubles distances: after round r it holds all pairs at distance up to 2^r; pairs at exactly that
  distance are joined with all pairs to give those up to twice as far.
* ``reachable`` walks from given seeds, ``PLAIN_ROUNDS`` levels edge by edge. If there is more, nodes with one way in and
  one way out (links of chains) are jumped over: jump tables grow fourfold a round until they end at a node that is no link,
  the walk goes on over the jumps, and the links in between get their distance from where their chain
  begins. A round is then a level of branching nodes, not of links.

Loops end when a round brings nothing new (one ``isEmpty`` per round — no rows travel). Lineage is cut with
``checkpoint()`` into the folder the session names in ``spark.checkpoint.dir``, so a lost executor recomputes at most
one round. What was visited is kept in tables that are merged when as large as the next (as many as the logarithm
of the rounds), not one per level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.session import materialize


#: Levels that ``reachable`` walks before it builds jump tables; most plant graphs end earlier.
PLAIN_ROUNDS = 4


def _cut(df: DataFrame) -> DataFrame:
    return materialize(df)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


class _Visited:
    """Rows seen so far in tables of growing size: a new table is merged with the one before while that is not larger."""

    def __init__(self):
        self.tables: list[tuple[int, DataFrame]] = []

    def add(self, df: DataFrame) -> None:
        size = df.count()
        while self.tables and self.tables[-1][0] <= size:
            n, older = self.tables.pop()
            size, df = size + n, _cut(older.unionByName(df))
        self.tables.append((size, df))

    def rows(self) -> DataFrame:
        return _union([t for _, t in self.tables])


def closure(edges: DataFrame, max_depth: int | None = None, rounds: list | None = None) -> DataFrame:
    """All (root, node, depth) with ``node`` reachable from ``root`` in one or more steps along ``edges(src, dst)``;
    ``depth`` is the fewest steps. A node on a cycle reaches itself. ``rounds`` gets an entry per round."""
    pairs = _cut(edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).where("root is not null and node is not null")
                 .distinct().withColumn("depth", F.lit(1)))
    reach, rounds = 1, [] if rounds is None else rounds
    while max_depth is None or reach < max_depth:
        rounds.append(reach)
        far = pairs.where(F.col("depth") == reach).select("root", F.col("node").alias("_mid"), F.col("depth").alias("_d"))
        rest = pairs.select(F.col("root").alias("_mid"), "node", F.col("depth").alias("_e"))
        new = (far.join(rest, "_mid").groupBy("root", "node").agg(F.min(F.col("_d") + F.col("_e")).alias("depth"))
               .join(pairs.select("root", "node"), ["root", "node"], "left_anti"))
        if max_depth is not None:
            new = new.where(F.col("depth") <= max_depth)
        new = _cut(new)
        if new.isEmpty():
            break
        pairs = _cut(pairs.unionByName(new))
        reach *= 2
    return pairs


def _jumps(edges: DataFrame, keep: DataFrame, rounds: list) -> tuple[DataFrame, DataFrame]:
    """(jumps, links). A link has one edge in and one out and is none of ``keep`` (node). ``jumps(src, dst, steps)`` leads
    from every node that is no link to the next such node, over the links between them; ``links(head, node, steps)``
    names for every link the node that its chain begins at. Cycles of nothing but links cannot be entered and are left out."""
    ways = (edges.select(F.col("_src").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o"))
            .unionByName(edges.select(F.col("_dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")))
            .groupBy("n").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).where("i = 1 and o = 1").select("n"))
    link = _cut(ways.join(keep.select(F.col("node").alias("n")).distinct(), "n", "left_anti"))
    n_links = link.count()
    no = F.lit(False)
    mark = _cut(edges.join(link.select(F.col("n").alias("_src"), F.lit(True).alias("_s")), "_src", "left")
                .join(link.select(F.col("n").alias("_dst"), F.lit(True).alias("_d")), "_dst", "left")
                .select("_src", "_dst", F.coalesce("_s", no).alias("_s"), F.coalesce("_d", no).alias("_d")))

    def doubled(t: DataFrame) -> DataFrame:
        via = t.select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = (t.where("not done").join(via, "at")
                 .select("node", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done")))
        return t.where("done").unionByName(moved.where(F.col("steps") <= n_links))      # more steps than links: a cycle

    # every link looks back: ``steps`` before it stands ``at``, done when that is no link
    back = _cut(mark.where("_d").select(F.col("_dst").alias("node"), F.col("_src").alias("at"), F.lit(1).alias("steps"), (~F.col("_s")).alias("done")))
    while not back.where("not done").isEmpty():
        rounds.append("jump")
        back = _cut(doubled(doubled(back)))
    links = back.select(F.col("at").alias("head"), "node", "steps")
    ends = mark.where("_s and not _d").select(F.col("_src").alias("node"), F.col("_dst").alias("dst"))
    over = links.join(ends, "node").select(F.col("head").alias("src"), "dst", (F.col("steps") + 1).alias("steps"))
    plain = mark.where("not _s and not _d").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.lit(1).alias("steps"))
    return _cut(plain.unionByName(over).groupBy("src", "dst").agg(F.min("steps").alias("steps"))), links


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, start_depth: int = 0,
              rounds: list | None = None) -> DataFrame:
    """All (root, node, depth) with ``node`` reachable from ``root`` along ``edges(src, dst)``; ``depth`` is the fewest
    steps. ``seeds`` holds (root, node) pairs at ``start_depth``. Cycles end because a pair is only walked again at a
    smaller depth. ``rounds`` gets an entry per round."""
    rounds = [] if rounds is None else rounds
    e = _cut(edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")).where("_src is not null and _dst is not null").distinct())
    start = _cut(seeds.select("root", "node").where("node is not null").distinct().withColumn("depth", F.lit(start_depth)))
    step_by, links = e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.lit(1).alias("steps")), None
    visited, frontier = _Visited(), start
    visited.add(start)
    while True:
        if links is None and len(rounds) >= PLAIN_ROUNDS:
            step_by, links = _jumps(e, start.select("node").unionByName(frontier.select("node")), rounds)
        rounds.append("walk")
        step = (frontier.join(step_by, frontier["node"] == step_by["src"])
                .select("root", F.col("dst").alias("node"), (F.col("depth") + F.col("steps")).alias("depth")))
        if max_depth is not None:
            step = step.where(F.col("depth") <= max_depth)
        step = step.groupBy("root", "node").agg(F.min("depth").alias("depth"))
        if links is None:                                # one edge at a time: the first visit is the shortest
            step = step.join(visited.rows(), ["root", "node"], "left_anti")
        else:
            best = visited.rows().groupBy("root", "node").agg(F.min("depth").alias("_known"))
            step = step.join(best, ["root", "node"], "left").where("_known is null or depth < _known")
        step = _cut(step.select("root", "node", "depth"))
        if step.isEmpty():
            break
        visited.add(step)
        frontier = step
    if links is None:
        return visited.rows()
    found = visited.rows()
    between = (found.join(links.select(F.col("head").alias("node"), F.col("node").alias("_link"), "steps"), "node")
               .select("root", F.col("_link").alias("node"), (F.col("depth") + F.col("steps")).alias("depth")))
    if max_depth is not None:
        between = between.where(F.col("depth") <= max_depth)
    return found.unionByName(between).groupBy("root", "node").agg(F.min("depth").alias("depth"))


def walk_up(parents: DataFrame, max_depth: int | None = None, rounds: list | None = None) -> DataFrame:
    """Ancestor path per node from a (node, parent) table with at most one parent per node.

    Returns (node, path) with ``path`` ordered root first, ending with the direct parent; a node without a
    parent gets an empty path. A cycle stops at the first repeated node: whatever follows a repeated node has been
    seen too, so the distinct nodes in order of their first place are the path. A node that is its own parent has
    itself as path. ``rounds`` gets an entry per round."""
    none = F.array().cast("array<string>")
    nodes = parents.select("node").unionByName(parents.select(F.col("parent").alias("node"))).where("node is not null").distinct()
    par = parents.select(F.col("node").alias("_n"), F.col("parent").alias("tip"))
    state = (nodes.join(par, nodes["node"] == par["_n"], "left")
             .select("node", F.when(F.col("tip").isNull(), none).otherwise(F.array("tip")).alias("path"),
                     F.when(F.col("tip") != F.col("node"), F.col("tip")).alias("tip")))
    state = _cut(state)
    reach, rounds = 1, [] if rounds is None else rounds
    while max_depth is None or reach < max_depth + 1:
        if state.where("tip is not null").isEmpty():
            break
        rounds.append(reach)
        via = state.select(F.col("node").alias("tip"), F.col("path").alias("_path"), F.col("tip").alias("_tip"))
        longer = F.concat("path", F.coalesce("_path", none))
        whole = F.array_distinct(longer)
        again = F.size(whole) < F.size(longer)                     # the walk came back to a node of the path
        at_self = F.array_contains(whole, F.col("node"))            # or to the node itself
        moved = (state.where("tip is not null").join(via, "tip", "left")
                 .select("node", F.array_remove(whole, F.col("node")).alias("path"), F.when(~(again | at_self), F.col("_tip")).alias("tip")))
        state = _cut(state.where("tip is null").unionByName(moved))
        reach *= 2
    path = F.col("path") if max_depth is None else F.slice("path", 1, max_depth + 1)
    return state.select("node", F.reverse(path).alias("path"))
