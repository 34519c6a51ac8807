"""Row → triple mapping (M1, M3).

A mapping declares, for one source DataFrame, the subject expression, an optional type, one
object expression per predicate and metadata columns copied onto every triple. ``apply`` is a
single projection followed by ``inline`` of an array of (p, o) structs, so the source is scanned
once however many predicates there are, and the row multiplication happens after column pruning
and before any shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from otgraph.functions.iri import RDF_TYPE


@dataclass
class TripleMapping:
    subject: Column
    predicate_objects: dict[str, Column]
    rdf_type: Column | None = None
    metadata: dict[str, Column] = field(default_factory=dict)
    type_predicate: str = RDF_TYPE

    def _pairs(self) -> Column:
        pairs = []
        if self.rdf_type is not None:
            pairs.append(F.struct(F.lit(self.type_predicate).alias("p"),
                                  self.rdf_type.cast("string").alias("o")))
        for pred, obj in self.predicate_objects.items():
            pairs.append(F.struct(F.lit(pred).alias("p"), obj.cast("string").alias("o")))
        # No triple for a NULL object.
        return F.filter(F.array(*pairs), lambda x: x["o"].isNotNull())

    def apply(self, df: DataFrame) -> DataFrame:
        """One triple per non-NULL object plus the type triple; metadata on every triple."""
        meta = [c.alias(name) for name, c in self.metadata.items()]
        return (
            df.select(self.subject.alias("s"), F.inline(self._pairs()), *meta)
            .select("s", "p", "o", *self.metadata.keys())
        )


def map_many(sources: dict[str, DataFrame], mappings: dict[str, TripleMapping]
             ) -> dict[str, DataFrame]:
    """Apply one mapping per target name (M3); each result is a lazy DataFrame."""
    return {name: m.apply(sources[name]) for name, m in mappings.items()}



def concat_batches(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Union of batches (lines, days, sources) by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=allow_missing)
    return out
