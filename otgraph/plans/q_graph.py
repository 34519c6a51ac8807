"""Registered queries over the plant graph (TPC-H tables as triples)."""

from __future__ import annotations

from pyspark.sql import functions as F

from otgraph.functions.iri import (DEPENDS_ON, PART_OF, PROPAGATES, RDF_TYPE, RDF_TYPE_IRI,
                                   RDFS_LABEL, RDFS_COMMENT, HAS_STATE)
from otgraph.operators import bgp as B
from otgraph.operators import graph as G
from otgraph.plans.adapters import (BALANCE, LOCATED_IN, NS, SHIPPED_FROM, plant_graph,
                                    with_ctes)
from otgraph.plans.catalog import register
from otgraph.sources.files import load_turtle
from otgraph.sources.sinks import write_ntriples
from otgraph.streaming.ingest import checkpoint_path

SKIP = ("NOT (suffix(p, 'subPropertyOf') OR suffix(p, 'hasState') OR suffix(p, 'comment')"
        " OR suffix(p, 'label') OR suffix(p, 'range') OR suffix(p, 'domain')"
        f" OR (p IN ('{RDF_TYPE}', '{RDF_TYPE_IRI}') AND (suffix(o, 'Property') OR suffix(o, 'Class')))"
        " OR suffix(o, 'state'))")
LOCAL = "regexp_extract(rtrim({c}, '/'), '[^#/]*$')"
SPC = ("spc(sub, super, depth) AS (SELECT s, o, 1 FROM plant_graph WHERE suffix(p, 'subPropertyOf')"
       " UNION ALL SELECT c.sub, e.o, c.depth + 1 FROM spc c JOIN plant_graph e"
       " ON e.s = c.super AND suffix(e.p, 'subPropertyOf'))")


def _preds_sql(target: str, transitive: bool) -> str:
    if transitive:
        return f"(SELECT sub FROM spc WHERE super = '{target}' UNION SELECT '{target}')"
    return (f"(SELECT s FROM plant_graph WHERE suffix(p, 'subPropertyOf') AND o = '{target}'"
            f" UNION SELECT '{target}')")


def _g(spark, sf):
    return plant_graph(spark, sf)


@register("plant_triples", with_ctes("SELECT s, p, o FROM plant_graph", "plant_graph"))
def q_plant_triples(spark, sf):
    return _g(spark, sf)


@register("classify_partof", with_ctes(
    f"SELECT s, p, o FROM plant_graph WHERE p IN {_preds_sql(PART_OF, False)}", "plant_graph"))
def q_classify(spark, sf):
    return G.classify_edges(_g(spark, sf), PART_OF)


@register("classify_partof_transitive", with_ctes(
    f"SELECT s, p, o FROM plant_graph WHERE p IN {_preds_sql(PART_OF, True)}", "plant_graph",
    extra=SPC, recursive=True))
def q_classify_t(spark, sf):
    return G.classify_edges(_g(spark, sf), PART_OF, transitive=True)


@register("sub_property_closure", with_ctes(
    "SELECT sub, super, min(depth) AS depth FROM spc GROUP BY sub, super", "plant_graph",
    extra=SPC, recursive=True))
def q_spc(spark, sf):
    return G.sub_property_closure(_g(spark, sf))


@register("dependency_edges", with_ctes(
    f"SELECT o AS source, s AS target, {LOCAL.format(c='p')} AS label FROM plant_graph"
    f" WHERE {SKIP} AND p IN {_preds_sql(DEPENDS_ON, False)}", "plant_graph"))
def q_dependency_edges(spark, sf):
    return G.dependency_edges(_g(spark, sf))


_PARENTS_T = (f"SELECT s AS node, min(o) AS parent FROM plant_graph WHERE {SKIP}"
              f" AND p IN {_preds_sql(PART_OF, True)} GROUP BY s")


@register("parents", with_ctes(
    f"SELECT s AS node, min(o) AS parent FROM plant_graph WHERE {SKIP}"
    f" AND p IN {_preds_sql(PART_OF, False)} GROUP BY s", "plant_graph"))
def q_parents(spark, sf):
    return G.parents(_g(spark, sf))


_NODE_ATTRS = f"""SELECT t.s AS id, coalesce(l.label, {LOCAL.format(c='t.s')}) AS label, t.type,
  coalesce(st.state, 'operational') AS state, coalesce(c.comment, '') AS comment
FROM (SELECT DISTINCT s, o AS type FROM plant_graph WHERE {SKIP}
      AND p IN ('{RDF_TYPE}', '{RDF_TYPE_IRI}')) t
LEFT JOIN (SELECT s, min(o) AS label FROM plant_graph WHERE suffix(p, 'label')
           AND NOT suffix(p, 'subPropertyOf') GROUP BY s) l ON l.s = t.s
LEFT JOIN (SELECT s, min({LOCAL.format(c='o')}) AS state FROM plant_graph
           WHERE suffix(p, 'hasState') GROUP BY s) st ON st.s = t.s
LEFT JOIN (SELECT s, min(o) AS comment FROM plant_graph WHERE suffix(p, 'comment') GROUP BY s) c
  ON c.s = t.s"""


@register("node_attributes", with_ctes(_NODE_ATTRS, "plant_graph"))
def q_node_attributes(spark, sf):
    return G.node_attributes(_g(spark, sf))


_STRUCT = (f"SELECT a.*, p.parent FROM ({_NODE_ATTRS}) a LEFT JOIN (SELECT s AS node, min(o) AS parent"
           f" FROM plant_graph WHERE {SKIP} AND p IN {_preds_sql(PART_OF, False)} GROUP BY s) p"
           " ON p.node = a.id")


@register("structure_nodes", with_ctes(_STRUCT, "plant_graph"))
def q_structure(spark, sf):
    return G.structure_nodes(_g(spark, sf))


@register("node_types", with_ctes(f"SELECT DISTINCT type FROM ({_NODE_ATTRS})", "plant_graph"))
def q_node_types(spark, sf):
    return G.node_types(G.node_attributes(_g(spark, sf)))


@register("graph_elements", with_ctes(
    "SELECT 'node' AS kind, id, label, type, state, comment, parent, NULL AS source, NULL AS target"
    f" FROM ({_STRUCT}) UNION ALL SELECT 'edge', o || '|' || {LOCAL.format(c='p')} || '|' || s,"
    f" {LOCAL.format(c='p')}, NULL, NULL, NULL, NULL, o, s FROM plant_graph WHERE {SKIP}"
    f" AND p IN {_preds_sql(DEPENDS_ON, False)}", "plant_graph"))
def q_graph_elements(spark, sf):
    return G.graph_elements(_g(spark, sf))


_WALK = f"""par AS ({_PARENTS_T}),
nodes AS (SELECT node FROM par UNION SELECT parent FROM par),
walk(node, tip, path) AS (
  SELECT n.node, p.parent, CASE WHEN p.parent IS NULL THEN []::VARCHAR[] ELSE [p.parent] END
  FROM nodes n LEFT JOIN par p ON p.node = n.node
  UNION ALL
  SELECT w.node, p.parent, list_append(w.path, p.parent) FROM walk w JOIN par p ON p.node = w.tip
  WHERE NOT list_contains(w.path, p.parent) AND p.parent <> w.node),
paths AS (SELECT node, arg_max(path, len(path)) AS path FROM walk GROUP BY node)"""


@register("ancestor_paths", with_ctes(
    "SELECT node, array_to_string(list_reverse(path), ' > ') AS path_text, len(path) AS depth"
    " FROM paths", "plant_graph", extra=SPC + ",\n" + _WALK, recursive=True))
def q_ancestor_paths(spark, sf):
    g = _g(spark, sf)
    p = G.ancestor_paths(G.parents(g, transitive=True))
    return p.select("node", F.array_join("path", " > ").alias("path_text"),
                    F.size("path").alias("depth"))


@register("type_hierarchies", with_ctes(
    "SELECT type, arg_min(a.id, a.id) AS representative,"
    " coalesce(array_to_string(list_reverse(arg_min(p.path, a.id)), ' > '), '') AS path_text,"
    " coalesce(len(arg_min(p.path, a.id)), 0) AS depth,"
    " max(coalesce(len(arg_min(p.path, a.id)), 0)) OVER () AS max_depth"
    f" FROM ({_NODE_ATTRS}) a LEFT JOIN paths p ON p.node = a.id GROUP BY type",
    "plant_graph", extra=SPC + ",\n" + _WALK, recursive=True))
def q_type_hier(spark, sf):
    g = _g(spark, sf)
    paths = G.ancestor_paths(G.parents(g, transitive=True))
    h = G.type_hierarchies(G.node_attributes(g), paths)
    return h.select("type", "representative", F.array_join("path", " > ").alias("path_text"),
                    "depth", F.lit(1).alias("_one")) \
        .join(G.max_depth(h).withColumn("_one", F.lit(1)), "_one").drop("_one")


_IMPACT = f"""prop AS (SELECT o AS src, s AS dst FROM plant_graph
  WHERE p IN {_preds_sql(PROPAGATES, False)}),
reach(fault, node, depth) AS (
  SELECT s, s, 0 FROM plant_graph WHERE p = 'rdf:type' AND o = '{NS}/type/Region'
  UNION ALL SELECT r.fault, e.dst, r.depth + 1 FROM reach r JOIN prop e ON e.src = r.node)"""


@register("fault_impact", with_ctes(
    "SELECT fault, node, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY fault, node",
    "plant_graph", extra=_IMPACT, recursive=True))
def q_fault_impact(spark, sf):
    g = _g(spark, sf)
    faulty = g.filter((F.col("p") == RDF_TYPE) & (F.col("o") == f"{NS}/type/Region")) \
        .select(F.col("s").alias("node"))
    return G.fault_impact(g, faulty)


@register("property_path_plus", with_ctes(
    "SELECT DISTINCT x, y FROM pp", "plant_graph",
    extra=f"pp(x, y) AS (SELECT s, o FROM plant_graph WHERE p = '{PROPAGATES}'"
          f" UNION SELECT pp.x, e.o FROM pp JOIN plant_graph e ON e.s = pp.y"
          f" AND e.p = '{PROPAGATES}')", recursive=True))
def q_property_path(spark, sf):
    return G.property_path(_g(spark, sf), PROPAGATES, "+")


_T = f"{NS}/type/"


@register("bgp_select", with_ctes(
    "SELECT a.s AS sup, c.o AS nation_name, e.o AS region_name FROM plant_graph a"
    f" JOIN plant_graph b ON b.s = a.s AND b.p = '{SHIPPED_FROM}'"
    f" JOIN plant_graph c ON c.s = b.o AND c.p = '{RDFS_LABEL}'"
    f" JOIN plant_graph d ON d.s = b.o AND d.p = '{PART_OF}'"
    f" JOIN plant_graph e ON e.s = d.o AND e.p = '{RDFS_LABEL}'"
    f" WHERE a.p = 'rdf:type' AND a.o = '{_T}Supplier'", "plant_graph"))
def q_bgp_select(spark, sf):
    return B.bgp_select(_g(spark, sf), [
        ("?sup", RDF_TYPE, _T + "Supplier"), ("?sup", SHIPPED_FROM, "?n"),
        ("?n", RDFS_LABEL, "?nation_name"), ("?n", PART_OF, "?r"), ("?r", RDFS_LABEL, "?region_name"),
    ], select=["?sup", "?nation_name", "?region_name"])


@register("bgp_optional", with_ctes(
    f"SELECT a.s AS c, b.o AS name, st.o AS state FROM plant_graph a"
    f" JOIN plant_graph b ON b.s = a.s AND b.p = '{RDFS_LABEL}'"
    f" LEFT JOIN plant_graph st ON st.s = a.s AND st.p = '{HAS_STATE}'"
    f" WHERE a.p = 'rdf:type' AND a.o = '{_T}Customer'", "plant_graph"))
def q_bgp_optional(spark, sf):
    return B.bgp_select(_g(spark, sf), [("?c", RDF_TYPE, _T + "Customer"),
                                        ("?c", RDFS_LABEL, "?name")],
                        optional=[[("?c", HAS_STATE, "?state")]], select=["?c", "?name", "?state"])


@register("bgp_filter", with_ctes(
    f"SELECT a.s AS c, n.o AS n, a.o AS bal FROM plant_graph a"
    f" JOIN plant_graph n ON n.s = a.s AND n.p = '{LOCATED_IN}'"
    f" WHERE a.p = '{BALANCE}' AND TRY_CAST(a.o AS DOUBLE) > 5000", "plant_graph"))
def q_bgp_filter(spark, sf):
    return B.bgp_select(_g(spark, sf), [("?c", BALANCE, "?bal"), ("?c", LOCATED_IN, "?n")],
                        filters=["try_cast(bal AS DOUBLE) > 5000"], select=["?c", "?n", "?bal"])


@register("bgp_union", with_ctes(
    f"SELECT x.s AS x, x.o AS n, l.o AS nation_name FROM plant_graph x"
    f" JOIN plant_graph l ON l.s = x.o AND l.p = '{RDFS_LABEL}'"
    f" WHERE x.p IN ('{SHIPPED_FROM}', '{LOCATED_IN}')", "plant_graph"))
def q_bgp_union(spark, sf):
    return B.bgp_select(_g(spark, sf), [("?n", RDFS_LABEL, "?nation_name")],
                        union=[[("?x", SHIPPED_FROM, "?n")], [("?x", LOCATED_IN, "?n")]],
                        select=["?x", "?n", "?nation_name"])


_IN_REGION = NS + "/schema/inRegion"


@register("bgp_construct", with_ctes(
    f"SELECT DISTINCT a.s AS s, '{_IN_REGION}' AS p, b.o AS o FROM plant_graph a"
    f" JOIN plant_graph b ON b.s = a.o AND b.p = '{PART_OF}' WHERE a.p = '{LOCATED_IN}'",
    "plant_graph"))
def q_bgp_construct(spark, sf):
    return B.bgp_construct(_g(spark, sf), [("?c", LOCATED_IN, "?n"), ("?n", PART_OF, "?r")],
                           [("?c", _IN_REGION, "?r")])


@register("bgp_ask", with_ctes(
    f"SELECT count(*) > 0 AS ask FROM plant_graph a JOIN plant_graph b ON b.s = a.s"
    f" AND b.p = '{HAS_STATE}' WHERE a.p = 'rdf:type' AND a.o = '{_T}Supplier'", "plant_graph"))
def q_bgp_ask(spark, sf):
    return B.bgp_ask(_g(spark, sf), [("?x", RDF_TYPE, _T + "Supplier"), ("?x", HAS_STATE, "?st")])


@register("property_path_star", with_ctes(
    "SELECT DISTINCT x, y FROM pp UNION SELECT s, s FROM plant_graph WHERE p = '" + PROPAGATES + "'"
    " UNION SELECT o, o FROM plant_graph WHERE p = '" + PROPAGATES + "'", "plant_graph",
    extra=f"pp(x, y) AS (SELECT s, o FROM plant_graph WHERE p = '{PROPAGATES}'"
          f" UNION SELECT pp.x, e.o FROM pp JOIN plant_graph e ON e.s = pp.y"
          f" AND e.p = '{PROPAGATES}')", recursive=True))
def q_property_path_star(spark, sf):
    return G.property_path(_g(spark, sf), PROPAGATES, "*")


@register("bgp_star", with_ctes(
    "SELECT t.s AS c, l.o AS name, b.o AS balance, m.o AS segment, n.o AS nation, nl.o AS nation_name, r.o AS region"
    f" FROM plant_graph t JOIN plant_graph l ON l.s = t.s AND l.p = '{RDFS_LABEL}'"
    f" JOIN plant_graph b ON b.s = t.s AND b.p = '{BALANCE}' JOIN plant_graph m ON m.s = t.s AND m.p = '{RDFS_COMMENT}'"
    f" JOIN plant_graph n ON n.s = t.s AND n.p = '{LOCATED_IN}' JOIN plant_graph nl ON nl.s = n.o AND nl.p = '{RDFS_LABEL}'"
    f" JOIN plant_graph r ON r.s = n.o AND r.p = '{PART_OF}' WHERE t.p = 'rdf:type' AND t.o = '{_T}Customer'", "plant_graph"))
def q_bgp_star(spark, sf):
    """Two stars (customer, nation): two scans and one join, ordered by the counts per predicate."""
    g = _g(spark, sf)
    pats = [("?c", RDF_TYPE, _T + "Customer"), ("?c", RDFS_LABEL, "?name"), ("?c", BALANCE, "?balance"), ("?c", RDFS_COMMENT, "?segment"),
            ("?c", LOCATED_IN, "?nation"), ("?nation", RDFS_LABEL, "?nation_name"), ("?nation", PART_OF, "?region")]
    return B.bgp_select(g, pats, select=["?c", "?name", "?balance", "?segment", "?nation", "?nation_name", "?region"],
                        stats=B.predicate_stats(g, pats))


@register("bgp_path_to_constant", with_ctes(
    f"SELECT a.s AS x, a.o AS balance FROM plant_graph a WHERE a.p = '{BALANCE}' AND a.s IN (SELECT x FROM up)", "plant_graph",
    extra=f"up(x) AS (SELECT s FROM plant_graph WHERE p = '{PROPAGATES}' AND o = '{NS}/region-1'"
          f" UNION SELECT e.s FROM up JOIN plant_graph e ON e.o = up.x AND e.p = '{PROPAGATES}')", recursive=True))
def q_bgp_path_constant(spark, sf):
    """Customers that a fault of one region reaches: the walk begins at the region."""
    return B.bgp_select(_g(spark, sf), [("?x", BALANCE, "?balance"), ("?x", B.Path(PROPAGATES, "+"), f"{NS}/region-1")],
                        select=["?x", "?balance"])


@register("bgp_path_from_bindings", with_ctes(
    "SELECT x, y, l.o AS name FROM up JOIN plant_graph l ON l.s = up.y"
    f" AND l.p = '{RDFS_LABEL}'", "plant_graph",
    extra=f"up(x, y) AS (SELECT s, s FROM plant_graph WHERE p = '{HAS_STATE}'"
          f" UNION SELECT up.x, e.o FROM up JOIN plant_graph e ON e.s = up.y AND e.p = '{PROPAGATES}')", recursive=True))
def q_bgp_path_bindings(spark, sf):
    """Everything that degraded customers depend on, themselves included: the walk begins at the matched customers."""
    return B.bgp_select(_g(spark, sf), [("?x", HAS_STATE, "?st"), ("?x", B.Path(PROPAGATES, "*"), "?y")],
                        optional=[[("?y", RDFS_LABEL, "?name")]], filters=["name IS NOT NULL"], select=["?x", "?y", "?name"])


@register("turtle_roundtrip", with_ctes(
    f"SELECT s, CASE WHEN p = 'rdf:type' THEN '{RDF_TYPE_IRI}' ELSE p END AS p, o,"
    f" CASE WHEN p IN ('rdf:type', '{RDF_TYPE_IRI}') THEN 'iri' ELSE 'literal' END AS o_type FROM plant_graph", "plant_graph"))
def q_turtle_roundtrip(spark, sf):
    """The plant graph written as text and read back as Turtle, in ranges and chunks."""
    path = f"{checkpoint_path(spark, 'turtle')}/graph"
    write_ntriples(_g(spark, sf), path)
    return load_turtle(spark, path).select("s", "p", "o", "o_type")
