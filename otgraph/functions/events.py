"""Tag-event field helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["tag_provider", "variant_kind", "typed_value", "is_good_quality", "quality_fields",
           "scale_offset"]

# Quality code of a good reading, the marker text searched for, data-type labels.
GOOD_QUALITY_CODE = 192
GOOD_MARKER = "good"
DATA_TYPES = ("DOUBLE", "STRING", "BOOLEAN", "UNKNOWN")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tag_provider(tag_path) -> Column:
    """Text inside a leading ``[..]``; 'default' when absent or empty."""
    prov = F.regexp_extract(_col(tag_path), r"^\[([^\]]+)\]", 1)
    return F.when(prov.isNull() | (prov == ""), F.lit("default")).otherwise(prov)


def variant_kind(v) -> Column:
    """Coarse kind of a VARIANT value: NUMBER, STRING, BOOLEAN, NULL (JSON null / missing), OTHER."""
    t = F.schema_of_variant(_col(v))
    return (
        F.when(_col(v).isNull() | (t == "VOID"), F.lit("NULL"))
        .when(t.startswith("DECIMAL") | t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE",
                                               "FLOAT"), F.lit("NUMBER"))
        .when(t == "STRING", F.lit("STRING"))
        .when(t == "BOOLEAN", F.lit("BOOLEAN"))
        .otherwise(F.lit("OTHER"))
    )


def typed_value(v) -> dict[str, Column]:
    """Split a dynamic (VARIANT) value into numeric / string / boolean / data_type.

    Arrays, objects and JSON null are UNKNOWN and fill no typed column.
    """
    kind = variant_kind(v)
    return {
        "numeric_value": F.when(kind == "NUMBER", F.try_variant_get(_col(v), "$", "double")),
        "string_value": F.when(kind == "STRING", F.try_variant_get(_col(v), "$", "string")),
        "boolean_value": F.when(kind == "BOOLEAN", F.try_variant_get(_col(v), "$", "boolean")),
        "data_type": (F.when(kind == "NUMBER", "DOUBLE").when(kind == "STRING", "STRING")
                      .when(kind == "BOOLEAN", "BOOLEAN").otherwise("UNKNOWN")),
    }


def is_good_quality(q) -> Column:
    """Quality text contains 'good', case-blind; NULL quality is not good."""
    return F.coalesce(F.lower(_col(q)).contains(GOOD_MARKER), F.lit(False))


def quality_fields(q, include: bool = True) -> dict[str, Column]:
    """Quality text and code: 192 when good and included, else '' / 0."""
    if not include:
        return {"quality": F.lit(""), "quality_code": F.lit(0)}
    return {
        "quality": F.coalesce(_col(q), F.lit("")),
        "quality_code": F.when(is_good_quality(q), F.lit(GOOD_QUALITY_CODE)).otherwise(F.lit(0)),
    }


def scale_offset(numeric, boolean, scale, offset) -> Column:
    """``v*coalesce(scale,1)+coalesce(offset,0)``; booleans become 1.0/0.0 unscaled."""
    return (
        F.when(_col(numeric).isNotNull(),
               _col(numeric) * F.coalesce(_col(scale), F.lit(1.0)) + F.coalesce(_col(offset), F.lit(0.0)))
        .when(_col(boolean).isNotNull(), _col(boolean).cast("double"))
    )
