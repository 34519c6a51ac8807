"""Model registry operations as DataFrame transforms.

A registry is a DataFrame with the ``RDF_MODELS`` columns. Writes return new DataFrames; the
caller persists them (``otgraph.sources.sinks.write_snapshot``) — a new version per change.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: the largest page the registry API serves.
MAX_PAGE = 100
UPDATABLE = ("name", "description", "category", "content", "is_template", "metadata", "tags")


def _ts(now) -> Column:
    return now if isinstance(now, Column) else F.to_timestamp(F.lit(str(now)))


def search_condition(category: str | None = None, text: str | None = None) -> Column:
    """Equality on category and a case-blind ``%text%`` match on name, description or the
    whole content."""
    cond = F.lit(True)
    if category:
        cond = cond & (F.col("category") == category)
    if text:
        pat = f"%{text}%"
        cond = cond & (F.col("name").ilike(pat) | F.col("description").ilike(pat)
                       | F.col("content").ilike(pat))
    return cond


def search_models(df: DataFrame, category: str | None = None, text: str | None = None
                  ) -> DataFrame:
    """Registry rows matching :func:`search_condition`."""
    return df.filter(search_condition(category, text))


def page_models(df: DataFrame, limit: int = 50, offset: int = 0, category: str | None = None,
                text: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, totals): newest first (ties by id), ``offset`` then ``limit`` ≤ 100 rows (L3);
    totals holds ``total_all`` (ignores the filters, as the registry API reports) and
    ``total_filtered``. Paging is the feature, so the limit stays."""
    if limit > MAX_PAGE or limit < 1:
        raise ValueError(f"limit must be within 1..{MAX_PAGE}")
    cond = search_condition(category, text)
    page = df.filter(cond).orderBy(F.col("created_at").desc(), F.col("id").desc()) \
        .offset(int(offset)).limit(int(limit))
    totals = df.agg(F.count(F.lit(1)).alias("total_all"),
                    F.count_if(cond).alias("total_filtered"))
    return page, totals


def insert_if_absent(models: DataFrame, new: DataFrame, now=None, order: str = "id"
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(result, inserted, conflicts) (J8): a new row is inserted unless its name exists; of
    duplicate names inside ``new`` the first in ``order`` wins, the rest are conflicts too.
    Missing fields take the registry defaults; created/updated times are ``now``."""
    w = Window.partitionBy("name").orderBy(F.col(order))
    ranked = new.withColumn("_rn", F.row_number().over(w))
    first = ranked.filter(F.col("_rn") == 1).drop("_rn")
    dup = ranked.filter(F.col("_rn") > 1).drop("_rn")
    inserted = first.join(models.select("name"), "name", "left_anti")
    taken = first.join(models.select("name"), "name", "left_semi")
    conflicts = taken.unionByName(dup)
    defaults = {"description": F.lit(""), "category": F.lit("user"),
                "is_template": F.lit(False), "creator": F.lit("anonymous"),
                "metadata": F.lit("{}"), "tags": F.array().cast("array<string>")}
    fill = {c: F.coalesce(F.col(c), d) if c in inserted.columns else d
            for c, d in defaults.items()}
    stamp = _ts(now) if now is not None else F.current_timestamp()
    stamp = stamp.cast(models.schema["created_at"].dataType)
    fill["created_at"] = stamp
    fill["updated_at"] = stamp
    inserted = inserted.withColumns(fill).select(*models.columns)
    return models.unionByName(inserted), inserted, conflicts


def update_models(models: DataFrame, patch: DataFrame, now) -> DataFrame:
    """Partial update by id (J9): every updatable column present in ``patch`` replaces the
    stored value of the matching rows, and ``updated_at`` becomes ``now``. A patch without
    updatable columns is rejected. Patches of different shapes go in one call with a column
    ``set_fields`` (array of names): a row then changes only the fields it names. Of several patch
    rows for one id the greatest (by its fields in order) counts, so no model row is doubled."""
    fields = [c for c in patch.columns if c in UPDATABLE]
    if not fields:
        raise ValueError("No updatable fields provided")
    named = "set_fields" in patch.columns
    one = F.struct(*[F.col(c) for c in fields], *([F.array_sort("set_fields").alias("set_fields")] if named else []))
    p = patch.groupBy(F.col("id").alias("_pid")).agg(F.max(one).alias("_one"))
    p = p.select("_pid", *[F.col("_one")[c].alias(f"_p_{c}") for c in fields],
                 *([F.col("_one.set_fields").alias("_p_set")] if named else []))
    j = models.join(p, models["id"] == p["_pid"], "left")
    hit = F.col("_pid").isNotNull()
    cols = []
    for c in models.columns:
        if c in fields:
            this = hit & F.array_contains("_p_set", c) if named else hit
            cols.append(F.when(this, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, _ts(now)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def delete_models(models: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining, removed ids) for the ids listed in ``ids`` (one column ``id``)."""
    i = ids.select("id").distinct()
    return models.join(i, "id", "left_anti"), models.join(i, "id", "left_semi").select("id")


def get_models(models: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    """Point lookups including content."""
    if isinstance(ids, DataFrame):
        return models.join(ids.select("id").distinct(), "id", "left_semi")
    return models.filter(F.col("id").isin(list(ids)))
