"""Graph operators over triples.

Triples are an edge list ``(s, p, o)``. Edge classification, node attributes and parents are
joins and aggregations; hierarchy paths, sub-property closure, fault impact and property paths
are iterative frontier joins (``otgraph.operators.recursion``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otgraph.functions.iri import (DEPENDS_ON, PART_OF, PROPAGATES,  # noqa: F401 (re-exported)
                                   SUB_PROPERTY_OF, is_type_predicate, local_name)
from otgraph.operators.recursion import closure, reachable, walk_up


def _ends(c: str, suffix: str):
    return F.col(c).endswith(suffix)


def skipped():
    """True for metadata and schema triples (F13): sub-property, state, comment, label, range
    and domain triples, class and property declarations, objects ending in 'state'."""
    meta = (_ends("p", "subPropertyOf") | _ends("p", "hasState") | _ends("p", "comment")
            | _ends("p", "label") | _ends("p", "range") | _ends("p", "domain"))
    decl = is_type_predicate("p") & (_ends("o", "Property") | _ends("o", "Class"))
    return meta | decl | _ends("o", "state")


def skip_schema_triples(df: DataFrame) -> DataFrame:
    """Drop metadata and schema triples before building elements."""
    return df.filter(~skipped())


def sub_properties(df: DataFrame, target: str, transitive: bool = False) -> DataFrame:
    """Predicates that are ``target`` or declared sub-properties of it (one column ``p``)."""
    sp = df.filter(_ends("p", "subPropertyOf")).select(F.col("s").alias("src_p"),
                                                      F.col("o").alias("dst_p")).distinct()
    if transitive:
        closure = sub_property_closure(df)
        subs = closure.filter(F.col("super") == target).select(F.col("sub").alias("p"))
    else:
        subs = sp.filter(F.col("dst_p") == target).select(F.col("src_p").alias("p"))
    me = df.sparkSession.createDataFrame([(target,)], "p string")
    return subs.unionByName(me).distinct()


def classify_edges(df: DataFrame, target: str, transitive: bool = False,
                   schema: DataFrame | None = None) -> DataFrame:
    """Triples of ``df`` whose predicate is ``target`` or a sub-property of it (J3); the
    sub-property declarations are read from ``schema`` (default: ``df`` itself)."""
    preds = sub_properties(schema if schema is not None else df, target, transitive)
    # lazy and unhinted: the planner broadcasts the few predicates when it sees their size
    return df.join(preds, on="p", how="left_semi").select("s", "p", "o")


def sub_property_closure(df: DataFrame) -> DataFrame:
    """Transitive ``subPropertyOf``: (sub, super, depth)."""
    edges = df.filter(_ends("p", "subPropertyOf")).select(F.col("s").alias("src"),
                                                         F.col("o").alias("dst"))
    r = closure(edges)
    return r.select(F.col("root").alias("sub"), F.col("node").alias("super"), "depth")


def dependency_edges(df: DataFrame, target: str = DEPENDS_ON, transitive: bool = False,
                     schema: DataFrame | None = None) -> DataFrame:
    """Edges from object to subject for ``dependsOn`` and its sub-properties."""
    e = classify_edges(skip_schema_triples(df), target, transitive,
                       schema=schema if schema is not None else df)
    return e.select(F.col("o").alias("source"), F.col("s").alias("target"),
                    local_name("p").alias("label"))


def parents(df: DataFrame, target: str = PART_OF, transitive: bool = False,
            schema: DataFrame | None = None) -> DataFrame:
    """``partOf`` parent per node; of several parents the least IRI."""
    e = classify_edges(skip_schema_triples(df), target, transitive,
                       schema=schema if schema is not None else df)
    return e.groupBy(F.col("s").alias("node")).agg(F.min("o").alias("parent"))


def node_attributes(df: DataFrame, with_parent: bool = False, part_of: str = PART_OF,
                    transitive: bool = False, schema: DataFrame | None = None) -> DataFrame:
    """One row per (typed subject, type) with label (fallback local name), state (local name
    of ``hasState``, fallback 'operational') and comment (fallback '') (J4); with
    ``with_parent`` also the least ``partOf`` parent (G1). One aggregation per subject over the
    triples — types per subject are bounded by the vocabulary, never by the data."""
    base = df
    if with_parent:
        preds = sub_properties(schema if schema is not None else df, part_of, transitive)
        base = df.join(preds.withColumn("_is_part", F.lit(True)), on="p", how="left")
    keep = ~skipped()
    aggs = [
        F.min(F.when(_ends("p", "label"), F.col("o"))).alias("_label"),
        F.min(F.when(_ends("p", "hasState"), local_name("o"))).alias("_state"),
        F.min(F.when(_ends("p", "comment"), F.col("o"))).alias("_comment"),
        F.collect_set(F.when(is_type_predicate("p") & keep, F.col("o"))).alias("_types"),
    ]
    if with_parent:
        aggs.append(F.min(F.when(F.col("_is_part") & keep, F.col("o"))).alias("parent"))
    g = base.groupBy("s").agg(*aggs).filter(F.size("_types") > 0)
    return g.select(
        F.col("s").alias("id"), F.coalesce("_label", local_name("s")).alias("label"),
        F.explode("_types").alias("type"),
        F.coalesce("_state", F.lit("operational")).alias("state"),
        F.coalesce("_comment", F.lit("")).alias("comment"),
        *(["parent"] if with_parent else []))


def structure_nodes(df: DataFrame, part_of: str = PART_OF, schema: DataFrame | None = None
                    ) -> DataFrame:
    """Typed nodes with attributes and their parent (G1)."""
    return node_attributes(df, with_parent=True, part_of=part_of, schema=schema)


def node_types(nodes: DataFrame) -> DataFrame:
    """Distinct node types."""
    return nodes.select("type").distinct()


def graph_elements(df: DataFrame, part_of: str = PART_OF, depends_on: str = DEPENDS_ON,
                   schema: DataFrame | None = None) -> DataFrame:
    """Nodes and edges in one shape (U3): kind, id, label, type, state, comment, parent,
    source, target."""
    nodes = structure_nodes(df, part_of, schema).withColumn("kind", F.lit("node"))
    edges = dependency_edges(df, depends_on, schema=schema).select(
        F.lit("edge").alias("kind"), F.concat_ws("|", "source", "label", "target").alias("id"),
        "label", "source", "target")
    return nodes.unionByName(edges, allowMissingColumns=True)


def ancestor_paths(parent_df: DataFrame) -> DataFrame:
    """Root-first ancestor path per node, cycle safe."""
    return walk_up(parent_df)


def type_hierarchies(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Representative (least id) node per type, its path and depth."""
    j = nodes.select("id", "type").join(paths.withColumnRenamed("node", "id"), "id", "left")
    rep = j.groupBy("type").agg(F.min_by(F.struct("id", "path"), F.col("id")).alias("r"))
    return rep.select("type", F.col("r.id").alias("representative"),
                      F.coalesce(F.col("r.path"), F.array().cast("array<string>")).alias("path"),
                      F.coalesce(F.size("r.path"), F.lit(0)).alias("depth"))


def max_depth(hier: DataFrame) -> DataFrame:
    return hier.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"))


def fault_impact(df: DataFrame, faulty: DataFrame, target: str = PROPAGATES,
                 transitive: bool = False) -> DataFrame:
    """Entities reached from faulty ones along ``propagates`` (a fault in the object affects the
    subject) with the fewest hops (G7). ``faulty`` has one column ``node``; output
    (fault, node, depth) without the faulty node itself."""
    e = classify_edges(df, target, transitive).select(F.col("o").alias("src"),
                                                      F.col("s").alias("dst"))
    seeds = faulty.select(F.col("node").alias("root"), F.col("node"))
    r = reachable(e, seeds)
    return r.filter(F.col("depth") > 0).select(F.col("root").alias("fault"), "node", "depth")


def property_path(df: DataFrame, predicate: str, mode: str = "+", start: DataFrame | None = None,
                  end: DataFrame | None = None) -> DataFrame:
    """Pairs (x, y) with y reachable from x along ``predicate`` (G11): ``+`` one or more hops, ``*`` also (x, x).

    ``start`` (column ``node``) bounds x, ``end`` bounds y; the walk begins at the bound end, at ``start`` if both
    are, and visits nothing that it does not lead to. A bound node is a zero-length path of its own
    under ``*`` whether or not the predicate's triples name it; without a bound end all nodes of the triples are."""
    if mode not in ("+", "*"):
        raise ValueError("mode must be '+' or '*'")
    e = df.filter(F.col("p") == predicate).select(F.col("s").alias("src"), F.col("o").alias("dst"))
    if start is None and end is None:
        pairs = closure(e).select(F.col("root").alias("x"), F.col("node").alias("y"))
        if mode == "+":
            return pairs
        ends = e.select(F.col("src").alias("x")).unionByName(e.select(F.col("dst").alias("x")))
        return pairs.unionByName(ends.distinct().select("x", F.col("x").alias("y"))).distinct()
    if start is None:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = (end if start is None else start).select("node").where("node is not null").distinct()
    first = seeds.join(e, seeds["node"] == e["src"]).select(F.col("src").alias("root"), F.col("dst").alias("node"))
    pairs = reachable(e, first, start_depth=1).select("root", "node")
    if mode == "*":
        pairs = pairs.unionByName(seeds.select(F.col("node").alias("root"), "node")).distinct()
    if start is None:
        return pairs.select(F.col("node").alias("x"), F.col("root").alias("y"))
    pairs = pairs.select(F.col("root").alias("x"), F.col("node").alias("y"))
    return pairs if end is None else pairs.join(end.select(F.col("node").alias("y")).distinct(), "y", "left_semi").select("x", "y")
