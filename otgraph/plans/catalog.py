"""Registered queries: name → (Spark builder, DuckDB oracle SQL or None).

Every builder takes (spark, sf_dir) and reads whole driver tables; none caps rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None, rounded: tuple[str, ...] = (), digits: int = 6):
    """Register a query. ``rounded`` names float outputs of order-dependent aggregates (sums,
    averages, library maths): both sides report them rounded to ``digits`` places, so the
    comparison does not depend on summation order. The operators themselves never round."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        run, text = fn, sql
        if rounded:
            def run(spark, sf, _fn=fn):
                from pyspark.sql import functions as F
                return _fn(spark, sf).withColumns({c: F.round(c, digits) for c in rounded})
            run.__name__ = fn.__name__
            if sql is not None:
                rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in rounded)
                text = f"SELECT * REPLACE ({rep}) FROM ({sql}) AS rounded_output"
        REGISTRY[name] = (run, text)
        return fn
    return deco


def load_all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    # Importing the modules registers their queries.
    from otgraph.plans import (q_events, q_gold, q_graph, q_models, q_sources,  # noqa: F401
                               q_stores, q_streaming, q_triples)
    return REGISTRY
