"""Every registered query against its DuckDB oracle on the smallest driver tables, plus the
smoke entry point."""

from small_data import SF_SMALL


def test_entry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["s", "p", "o", "timestamp"]
    assert df.count() > 0


def test_every_query_matches_oracle(spark):
    from otgraph.plans.catalog import load_all
    from otgraph.plans.verify import check
    log = []
    bad = check(spark, SF_SMALL, only=sorted(load_all()), log=log.append)
    assert not bad, "\n".join(log)


def test_registered_queries_have_oracles():
    import __spark_entry__ as E
    from otgraph.plans.catalog import load_all
    q, o = load_all(), E.oracle_sql()
    assert sorted(set(q) - set(o)) == [] and set(q) <= set(E.queries())
