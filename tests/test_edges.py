"""Edge cases the oracle data does not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from otgraph.operators import bgp as B
from otgraph.operators import graph as G
from otgraph.operators import models as M
from otgraph.operators import select as S
from otgraph.operators.gold import events_in_intervals
from otgraph.schemas import RDF_MODELS

T0 = dt.datetime(2024, 1, 1)


def test_pattern_cap_keeps_first_tags_in_path_order(spark):
    df = spark.createDataFrame([(p,) for p in ["b1", "a1", "a1", "c1", "d2"]], "tag_path string")
    got = sorted(r.tag_path for r in S.select_pattern(df, r"[a-c]1", cap=2).collect())
    assert got == ["a1", "a1", "b1"]


def _registry(spark):
    rows = [(i, f"m{i}", "", "user", False, "text", "me", T0 + dt.timedelta(hours=i),
             T0 + dt.timedelta(hours=i), "{}", ["x"]) for i in range(5)]
    return spark.createDataFrame(rows, RDF_MODELS)


def test_registry_guards(spark):
    reg = _registry(spark)
    with pytest.raises(ValueError):
        M.page_models(reg, limit=101)
    with pytest.raises(ValueError):
        M.update_models(reg, spark.createDataFrame([(1,)], "id int"), T0)
    page, totals = M.page_models(reg, limit=2, offset=1)
    assert [r.id for r in page.collect()] == [3, 2]
    assert tuple(totals.collect()[0]) == (5, 5)
    remaining, removed = M.delete_models(reg, spark.createDataFrame([(1,), (9,)], "id int"))
    assert remaining.count() == 4 and [r.id for r in removed.collect()] == [1]


def test_pattern_builder_rejects_unshared_groups(spark):
    g = spark.createDataFrame([("a", "p", "b"), ("c", "q", "d")], "s string, p string, o string")
    with pytest.raises(ValueError):
        B.bgp_select(g, [("?x", "p", "?y")], union=[[("?u", "q", "?v")]])
    with pytest.raises(ValueError):
        B.bgp_select(g, [("?x", "p", "?y")], optional=[[("?u", "q", "?v")]])


def test_overlapping_intervals_use_the_range_join(spark):
    ev = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=m), str(m)) for m in (1, 3, 6)],
                               "k string, ts timestamp, id string")
    iv = spark.createDataFrame([("a", T0, T0 + dt.timedelta(minutes=4), "x"),
                                ("a", T0 + dt.timedelta(minutes=2), T0 + dt.timedelta(minutes=7), "y")],
                               "k string, start_ts timestamp, end_ts timestamp, name string")
    got = sorted((r.id, r.name) for r in
                 events_in_intervals(ev, iv, ["k"], disjoint=False, bucket_seconds=120).collect())
    assert got == [("1", "x"), ("3", "x"), ("3", "y"), ("6", "y")]


def test_ancestor_walk_depth_cap(spark):
    par = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a")], "node string, parent string")
    full = {r.node: r.path for r in G.ancestor_paths(par).collect()}
    assert full["d"] == ["a", "b", "c"]
    from otgraph.operators.recursion import walk_up
    capped = {r.node: r.path for r in walk_up(par, max_depth=1).collect()}
    assert capped["d"] == ["b", "c"]


def test_pattern_keeps_every_tag(spark):
    df = spark.range(60_000).select(F.concat(F.lit("[p]T/"), "id").alias("tag_path"))
    assert S.select_pattern(df, r"\[p\]T/.*").count() == 60_000


def test_alternation_over_providers_loses_none(spark):
    df = spark.createDataFrame([("[a]X/1",), ("[b]Y/1",), ("[c]Z/1",)], "tag_path string")
    regex = r"\[a\]X/.*|\[b\]Y/.*"
    assert S.provider_filter(regex) is None
    assert S.provider_filter(r"\[(a|b)\](X|Y)/[|]") == ["a", "b"]
    assert {r.tag_path for r in S.select_pattern(df, regex).collect()} == {"[a]X/1", "[b]Y/1"}


def test_latest_telemetry_returns_all_components(spark):
    from otgraph.operators.triples import latest_telemetry
    df = spark.range(60).select(F.concat(F.lit("c"), "id").alias("component_id"), F.lit(T0).alias("timestamp"), F.lit(1.0).alias("x"))
    assert latest_telemetry(df, {"a": "x"}, "2024-01-02").count() == 60


def test_energy_bounds_keep_the_first_reading_out(spark):
    from otgraph.operators.gold import energy_kwh
    df = spark.createDataFrame([("a", T0, 3600.0), ("b", T0, 10.0), ("b", T0 + dt.timedelta(seconds=60), 3600.0)], "k string, ts timestamp, p double")
    got = {r.k: r.energy_kwh for r in energy_kwh(df, ["k"], "ts", "p", dt_bounds=(0.2, 5.0)).collect()}
    assert got == {"a": 0.0, "b": 5.0}


def test_null_keys_match_nothing_across_days(spark):
    from otgraph.operators.gold import asof_join
    left = spark.createDataFrame([(None, T0 + dt.timedelta(hours=h), h) for h in (1, 30)] + [("a", T0 + dt.timedelta(hours=50), 50)],
                                 "k string, ts timestamp, h int")
    right = spark.createDataFrame([(None, T0, 1.0), ("a", T0, 2.0)], "k string, ts timestamp, v double")
    got = {r.h: r.v for r in asof_join(left, right, ["k"], "ts", ["v"]).collect()}
    assert got == {1: None, 30: None, 50: 2.0}


def test_previous_row_of_a_null_key_crosses_midnight(spark):
    from otgraph.operators.series import with_prev
    df = spark.createDataFrame([(None, T0 + dt.timedelta(hours=h), h) for h in (1, 30, 100)], "k string, ts timestamp, v int")
    got = {r.v: r.prev_v for r in with_prev(df, ["k"], "ts", ["v"]).collect()}
    assert got == {1: None, 30: 1, 100: 30}


def test_two_day_look_back(spark):
    from otgraph.operators.gold import tracking_error
    df = spark.createDataFrame([("a", T0 + dt.timedelta(hours=h), float(h), 0.0) for h in (0, 30, 47, 60)], "k string, ts timestamp, x double, y double")
    got = {int(r.x): r.ma_error for r in tracking_error(df, ["k"], "ts", "x", "y", 2 * 86_400).collect()}
    assert got == {0: 0.0, 30: 15.0, 47: 77 / 3, 60: (30 + 47 + 60) / 3}


def test_rounding_by_the_exact_value(spark):
    from otgraph.functions.iri import state_value_number
    vals = [0.125, 2.675, 0.135, -0.125, 1.005, 0.0, 0.004, 0.005, 0.006, 123456.785, 1e18, 99.995, 7.0, 2.5e-9, -3.14159]
    df = spark.createDataFrame([(str(v), v) for v in vals], "o string, v double")
    for r in df.select("v", state_value_number("o").alias("x")).collect():
        assert r.x == round(r.v, 2), r


def test_bgp_order_by_variable_and_groups(spark):
    t = spark.createDataFrame([("a", "p", "x"), ("b", "p", "x"), ("c", "p", "y")], "s string, p string, o string")
    rows = B.bgp_select(t, [("?s", "p", "?o")], select=["?s"], order_by=["-?s"], limit=2).collect()
    assert [r.s for r in rows] == ["c", "b"]
    got = B.bgp_select(t, [("?s", "p", "?o")], group_by=["?o"], aggregates={"n": "count(s)"}, having="n > 1").collect()
    assert [(r.o, r.n) for r in got] == [("x", 2)]


def test_bad_records_become_null(spark):
    from otgraph.sources import telemetry as T
    raw = spark.createDataFrame([("oops", "c1"), ("1.5", "c2")], "oil_temperature string, component_id string")
    assert {r.component_id: r.oil_temperature for r in T.coerce_telemetry(raw).collect()} == {"c1": None, "c2": 1.5}
    ts = spark.createDataFrame([("never",)], "timestamp string")
    assert T.with_event_time(ts).first().event_ts is None


def test_turtle_escapes_and_title_case(spark, tmp_path):
    from otgraph.sources import files
    assert files._unescape(r'C:\\new\t\u00e9\"') == 'C:\\new\t\u00e9"'
    (tmp_path / "my_digital-twin.ttl").write_text("# A model\n")
    assert files.ttl_template_catalog(spark, str(tmp_path)).first().name == "My Digital-Twin"


def test_tag_tree_of_any_depth(spark, tmp_path):
    import json

    from otgraph.sources import files
    node = {"name": "leaf", "tagType": "AtomicTag", "dataType": "Int4"}
    for i in range(14):
        node = {"name": f"f{i}", "tagType": "Folder", "tags": [node]}
    (tmp_path / "t.json").write_text(json.dumps(node))
    assert files.load_tag_tree(spark, {"p": str(tmp_path / "t.json")}).count() == 1


def test_unreadable_snapshot_fails_the_batch(spark, tmp_path):
    import shutil

    from otgraph.sources import sinks
    from otgraph.streaming import ingest
    src, base = str(tmp_path / "in"), str(tmp_path / "snap")
    row = lambda s: spark.createDataFrame([(s, "p", "1", T0)], "s string, p string, o string, timestamp timestamp")

    def step(s):
        row(s).write.mode("append").parquet(src)
        ingest.latest_stream(ingest.stream_table(spark, src), base, str(tmp_path / "ckpt"), available_now=True).awaitTermination()

    step("a")
    step("b")
    assert {r.s for r in sinks.read_snapshot(spark, base).collect()} == {"a", "b"}
    shutil.move(sinks._pointer(spark, base)[1], str(tmp_path / "gone"))
    with pytest.raises(Exception):
        step("c")
    assert sinks.has_snapshot(spark, base)
