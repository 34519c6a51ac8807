"""IRI construction and inspection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default namespaces and vocabulary spellings used across the library.
DEFAULT_NS = "http://example.com/plant"
DT_NS = "http://example.com/digitaltwin/"
RDF_TYPE = "rdf:type"
RDF_TYPE_IRI = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_NS = "http://www.w3.org/2000/01/rdf-schema#"
PART_OF = DT_NS + "partOf"
DEPENDS_ON = DT_NS + "dependsOn"
PROPAGATES = DT_NS + "propagates"
SUB_PROPERTY_OF = RDFS_NS + "subPropertyOf"
RDFS_LABEL = RDFS_NS + "label"
RDFS_COMMENT = RDFS_NS + "comment"
HAS_STATE = DT_NS + "hasState"

__all__ = [
    "DEFAULT_NS", "DT_NS", "RDF_TYPE", "RDF_TYPE_IRI", "RDFS_NS", "PART_OF", "DEPENDS_ON",
    "PROPAGATES", "SUB_PROPERTY_OF", "RDFS_LABEL", "RDFS_COMMENT", "HAS_STATE",
    "component_iri", "type_iri", "predicate_iri", "clean_uri", "local_name",
    "component_id_from_iri", "state_value_number", "state_value_text", "is_type_predicate",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def component_iri(component_id, ns: str = DEFAULT_NS) -> Column:
    """``<ns>/component-<id>``."""
    return F.format_string(f"{ns}/component-%s", _col(component_id))


def type_iri(type_name: str, ns: str = DEFAULT_NS) -> Column:
    """``<ns>/type/<name>`` as a literal column."""
    return F.lit(f"{ns}/type/{type_name}")


def predicate_iri(name: str, ns: str = DEFAULT_NS) -> str:
    """``<ns>/pred/<name>`` (P2); a plain string because predicates are keys of a mapping."""
    return f"{ns}/pred/{name}"


def is_type_predicate(p) -> Column:
    """The short spelling written by the mapping and the full IRI from Turtle both mean type."""
    return _col(p).isin(RDF_TYPE, RDF_TYPE_IRI)


# The five HTML entities undone before quoting, '&amp;' last.
_HTML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
# Characters kept unquoted besides letters, digits and "_.-~".
_SAFE = ":/#?&=%@+"


def clean_uri(c) -> Column:
    """Unescape HTML entities, strip ``<``/``>`` and blanks at the ends, percent-quote.

    ``url_encode`` is form encoding (space → '+', escapes the safe set), so its output is
    turned into path quoting with plain replacements; '%25' is restored last so no escape
    sequence is created twice.
    """
    v = _col(c)
    for ent, ch in _HTML_ENTITIES:
        v = F.replace(v, F.lit(ent), F.lit(ch))
    v = F.regexp_replace(v, r"^[<>]+|[<>]+$", "")
    v = F.regexp_replace(v, r"^\s+|\s+$", "")
    q = F.url_encode(v)
    q = F.replace(q, F.lit("+"), F.lit("%20"))
    q = F.replace(q, F.lit("*"), F.lit("%2A"))
    q = F.replace(q, F.lit("%7E"), F.lit("~"))
    for ch in _SAFE:
        if ch == "%":
            continue
        q = F.replace(q, F.lit("%%%02X" % ord(ch)), F.lit(ch))
    q = F.replace(q, F.lit("%25"), F.lit("%"))
    return F.when(v.isNull() | (v == ""), v).otherwise(q)


def local_name(c) -> Column:
    """Last segment after '/' or '#', trailing slashes removed first."""
    return F.element_at(F.split(F.regexp_replace(_col(c), "/+$", ""), "[#/]"), -1)


def component_id_from_iri(c) -> Column:
    """Text after the last ``component-`` (P5)."""
    return F.substring_index(_col(c), "component-", -1)


def round_half_even(x, places: int = 2) -> Column:
    """A double rounded to ``places`` by its exact binary value, ties to even (2.675 is a little
    less than its text and gives 2.67). The value is an integer over a power of two, so the
    rounding is integer arithmetic."""
    x = _col(x)
    a = F.abs(x)
    k = (F.lit(53) - F.floor(F.log2(a))).cast("int")            # a * 2^k is a whole number
    n = (a * F.pow(F.lit(2.0), k)).cast("long") * (10 ** places)
    unit = F.call_function("shiftleft", F.lit(1).cast("long"), k)
    q = F.call_function("shiftright", n, k)
    rest = n - q * unit
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (q % 2 == 1))
    y = (q + F.when(up, 1).otherwise(0)) / float(10 ** places)
    done = (F.when(x.isNull() | F.isnan(x) | (a >= 2.0 ** 45), x).when(a < 0.1 ** places / 4, F.lit(0.0)))
    return done.otherwise(F.signum(x) * y)


def state_value_number(o) -> Column:
    """Numeric reading of an object rounded to two places, NULL for text."""
    return round_half_even(_col(o).try_cast("double"), 2)


def state_value_text(o) -> Column:
    """The object text when it is not numeric, else NULL."""
    return F.when(_col(o).try_cast("double").isNull(), _col(o))
