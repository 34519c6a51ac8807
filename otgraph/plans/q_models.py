"""Registered queries over the model registry (documents stand in for models)."""

from __future__ import annotations

from pyspark.sql import functions as F

from otgraph.operators import models as M
from otgraph.plans.adapters import NOW, register_cte, table, with_ctes
from otgraph.plans.catalog import register
from otgraph.sources.model_index import ModelIndex
from otgraph.streaming.ingest import checkpoint_path

_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def registry(docs):
    created = F.timestamp_seconds(F.lit(_EPOCH) + F.col("doc_id") * 3600).cast("timestamp_ntz")
    return docs.select(
        F.col("doc_id").cast("int").alias("id"),
        F.concat(F.lit("model-"), F.col("doc_id").cast("string")).alias("name"),
        F.concat(F.col("lang"), F.lit(" model from "), F.col("source")).alias("description"),
        F.col("source").alias("category"), (F.col("lang") != "en").alias("is_template"),
        F.col("text").alias("content"),
        F.concat(F.lit("user-"), (F.col("doc_id") % 5).cast("string")).alias("creator"),
        created.alias("created_at"), created.alias("updated_at"),
        F.concat(F.lit('{"n_chars": '), F.col("n_chars").cast("string"), F.lit("}"))
        .alias("metadata"),
        F.array(F.col("lang"), F.col("source")).alias("tags"))


register_cte("registry", f"""
SELECT CAST(doc_id AS INTEGER) AS id, 'model-' || CAST(doc_id AS VARCHAR) AS name,
  lang || ' model from ' || source AS description, source AS category, lang <> 'en' AS is_template,
  text AS content, 'user-' || CAST(doc_id % 5 AS VARCHAR) AS creator,
  make_timestamp(({_EPOCH} + doc_id * 3600) * 1000000) AS created_at,
  make_timestamp(({_EPOCH} + doc_id * 3600) * 1000000) AS updated_at,
  '{{"n_chars": ' || CAST(n_chars AS VARCHAR) || '}}' AS metadata, [lang, source] AS tags,
  lang
FROM documents""")

_COLS = ("id, name, description, category, is_template, creator, created_at, updated_at, "
         "metadata, array_to_string(tags, ',') AS tags_text")


def _out(df):
    return df.select("id", "name", "description", "category", "is_template", "creator",
                     "created_at", "updated_at", "metadata",
                     F.array_join("tags", ",").alias("tags_text"))


def _reg(spark, sf):
    return registry(table(spark, sf, "documents"))


@register("search_models", with_ctes(
    f"SELECT {_COLS} FROM registry WHERE name ILIKE '%license%' OR description ILIKE '%license%'"
    " OR content ILIKE '%license%'", "registry"))
def q_search(spark, sf):
    return _out(M.search_models(_reg(spark, sf), text="license"))


_TEXTS = ["license", "LICENSE", "model-1", "es model", "er%th", "q", "no such text at all"]


@register("search_models_indexed", with_ctes(" UNION ALL ".join(
    f"SELECT '{t}' AS asked, {_COLS} FROM registry WHERE name ILIKE '%{t}%' OR description ILIKE '%{t}%' OR content ILIKE '%{t}%'"
    for t in _TEXTS), "registry"))
def q_search_indexed(spark, sf):
    """The registry written with its trigram postings, then searched for several texts."""
    index = ModelIndex(spark, checkpoint_path(spark, "registry")).build(_reg(spark, sf))
    out = None
    for t in _TEXTS:
        part = _out(index.search(t)).withColumn("asked", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


@register("search_models_category", with_ctes(
    f"SELECT {_COLS} FROM registry WHERE category = 'src3' AND (name ILIKE '%the%' OR"
    " description ILIKE '%the%' OR content ILIKE '%the%')", "registry"))
def q_search_cat(spark, sf):
    return _out(M.search_models(_reg(spark, sf), category="src3", text="the"))


@register("page_models", with_ctes(
    f"SELECT {_COLS} FROM registry ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 100",
    "registry"))
def q_page(spark, sf):
    page, _totals = M.page_models(_reg(spark, sf), limit=50, offset=100)
    return _out(page)


@register("page_totals", with_ctes(
    "SELECT (SELECT count(*) FROM registry) AS total_all, (SELECT count(*) FROM registry"
    " WHERE category = 'src3') AS total_filtered", "registry"))
def q_page_totals(spark, sf):
    _page, totals = M.page_models(_reg(spark, sf), limit=50, category="src3")
    return totals


def _new_rows(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("lang").isin("es", "fr"))
    key = F.col("doc_id") - F.col("doc_id") % 2
    return d.select((F.col("doc_id") + 100000).cast("int").alias("id"),
                    F.concat(F.lit("model-"), key.cast("string")).alias("name"),
                    F.lit("imported").alias("description"), F.lit(None).cast("string")
                    .alias("category"), F.col("text").alias("content"))


register_cte("new_models", """
SELECT CAST(doc_id + 100000 AS INTEGER) AS id, 'model-' || CAST(doc_id - doc_id % 2 AS VARCHAR) AS name,
  text AS content FROM documents WHERE lang IN ('es', 'fr')""")
register_cte("new_first", "SELECT * FROM new_models QUALIFY row_number() OVER (PARTITION BY name"
             " ORDER BY id) = 1", ["new_models"])


@register("insert_if_absent", with_ctes(
    "SELECT id, name, category, created_at FROM registry WHERE lang <> 'es' UNION ALL"
    f" SELECT id, name, 'user', TIMESTAMP '{NOW}' FROM new_first"
    " WHERE name NOT IN (SELECT name FROM registry WHERE lang <> 'es')", "registry", "new_first"))
def q_insert(spark, sf):
    models = _reg(spark, sf).join(table(spark, sf, "documents").filter(F.col("lang") != "es")
                                  .select(F.col("doc_id").cast("int").alias("id")), "id", "left_semi")
    result, _ins, _conf = M.insert_if_absent(models, _new_rows(spark, sf),
                                             now=F.lit(NOW).cast("timestamp_ntz"))
    return result.select("id", "name", "category", "created_at")


@register("insert_conflicts", with_ctes(
    "SELECT id, name FROM new_models WHERE id NOT IN (SELECT id FROM new_first) OR name IN"
    " (SELECT name FROM registry WHERE lang <> 'es')", "registry", "new_first"))
def q_insert_conflicts(spark, sf):
    models = _reg(spark, sf).join(table(spark, sf, "documents").filter(F.col("lang") != "es")
                                  .select(F.col("doc_id").cast("int").alias("id")), "id", "left_semi")
    _res, _ins, conflicts = M.insert_if_absent(models, _new_rows(spark, sf))
    return conflicts.select("id", "name")


@register("update_models", with_ctes(
    "SELECT r.id, r.name, CASE WHEN p.id IS NOT NULL THEN p.description ELSE r.description END"
    " AS description, CASE WHEN p.id IS NOT NULL THEN p.category ELSE r.category END AS category,"
    f" CASE WHEN p.id IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE r.updated_at END AS updated_at"
    " FROM registry r LEFT JOIN (SELECT CAST(doc_id AS INTEGER) AS id, 'archived' AS category,"
    " 'patched ' || lang AS description FROM documents WHERE source = 'src1') p ON p.id = r.id",
    "registry"))
def q_update(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("source") == "src1")
    patch = d.select(F.col("doc_id").cast("int").alias("id"), F.lit("archived").alias("category"),
                     F.concat(F.lit("patched "), F.col("lang")).alias("description"))
    out = M.update_models(_reg(spark, sf), patch, F.lit(NOW).cast("timestamp_ntz"))
    return out.select("id", "name", "description", "category", "updated_at")


@register("delete_models", with_ctes(
    "SELECT id, name FROM registry WHERE lang <> 'fr'", "registry"))
def q_delete(spark, sf):
    ids = table(spark, sf, "documents").filter(F.col("lang") == "fr") \
        .select(F.col("doc_id").cast("int").alias("id"))
    remaining, _removed = M.delete_models(_reg(spark, sf), ids)
    return remaining.select("id", "name")


@register("get_models", with_ctes(
    "SELECT id, name, content, creator FROM registry WHERE id IN (SELECT doc_id FROM labels"
    " WHERE quality = 1)", "registry"))
def q_get(spark, sf):
    ids = table(spark, sf, "labels").filter(F.col("quality") == 1) \
        .select(F.col("doc_id").cast("int").alias("id"))
    return M.get_models(_reg(spark, sf), ids).select("id", "name", "content", "creator")
