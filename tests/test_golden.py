"""Golden cases: hand-made rows with literal expected output, one per quirk."""

import datetime as dt
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from otgraph.functions import events as E
from otgraph.functions import formulas as P
from otgraph.functions.iri import clean_uri, component_id_from_iri, local_name
from otgraph.operators import changes as C
from otgraph.operators import graph as G
from otgraph.operators import kpis as K
from otgraph.operators import select as S
from otgraph.operators import silver as V
from otgraph.operators import triples as T
from otgraph.operators.gold import asof_join, flag_intervals
from otgraph.operators.mapping import TripleMapping

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def ts(minutes=0, seconds=0):
    return T0 + dt.timedelta(minutes=minutes, seconds=seconds)


def test_mapping_skips_null_object(spark):
    df = spark.createDataFrame([("c1", 1.0, None, "x", ts())],
                               "cid string, a double, b double, c string, t timestamp")
    m = TripleMapping(subject=F.concat(F.lit("s/"), F.col("cid")),
                      predicate_objects={"pa": F.col("a"), "pb": F.col("b"), "pc": F.col("c")},
                      rdf_type=F.lit("Type"), metadata={"timestamp": F.col("t")})
    rows = sorted(m.apply(df).select("p", "o").collect())
    assert rows == [Row(p="pa", o="1.0"), Row(p="pc", o="x"), Row(p="rdf:type", o="Type")]


def _triples(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string, timestamp timestamp")


def test_point_in_time_is_strict(spark):
    df = _triples(spark, [("s", "p", "10:00", ts(0)), ("s", "p", "10:05", ts(5))])
    assert T.point_in_time(df, ts(5)).collect()[0].o == "10:00"
    assert T.point_in_time(df, ts(6)).collect()[0].o == "10:05"


def test_tie_takes_greater_object(spark):
    df = _triples(spark, [("s", "p", "a", ts()), ("s", "p", "b", ts())])
    assert T.latest_triples(df).collect()[0].o == "b"


def test_latest_pivot_defaults_to_zero(spark):
    df = _triples(spark, [("ns/component-7", "pa", "3.5", ts()), ("ns/component-7", "pb", "None", ts())])
    r = T.telemetry_from_triples(df, {"A": "pa", "B": "pb", "C": "pc", "D": "pd"},
                                 "ns/component-").collect()[0]
    assert (r.component_id, r.A, r.B, r.C, r.D) == ("7", 3.5, 0.0, 0.0, 0.0)


def test_state_map(spark):
    df = _triples(spark, [("s1", "ns/pred/x", "1.234", ts()), ("s1", "ns/pred/y", "on", ts()),
                          ("s2", "rdf:type", "T", ts())])
    got = {r.s: r.state for r in T.state_map(df).collect()}
    assert got == {"s1": {"x": "1.23", "y": "on"}, "s2": {}}


def _ot(spark, values, tag="t"):
    rows = []
    for i, v in enumerate(values):
        dtp = "UNKNOWN" if v is None else ("DOUBLE" if isinstance(v, float) else "STRING")
        rows.append((str(i), ts(seconds=i), tag, v if isinstance(v, float) else None,
                     v if isinstance(v, str) else None, None, dtp))
    return spark.createDataFrame(rows, "event_id string, event_time timestamp, tag_path string, "
                                       "numeric_value double, string_value string, "
                                       "boolean_value boolean, data_type string")


def _vals(df):
    out = []
    for r in df.orderBy("event_time").collect():
        out.append(r.numeric_value if r.data_type == "DOUBLE" else r.string_value)
    return out


def test_deadband_keeps_last_kept_not_previous(spark):
    df = _ot(spark, [1.0, 1.4, 1.8, 3.0])
    assert _vals(C.deadband(df, 0.5)) == [1.0, 1.8, 3.0]


def test_change_filter_nulls(spark):
    df = _ot(spark, [None, 5.0, None, None])
    got = C.only_on_change(df).orderBy("event_time").collect()
    assert [(r.event_id, r.numeric_value) for r in got] == [("1", 5.0), ("2", None)]
    got2 = C.deadband(df, 0.0).orderBy("event_time").collect()
    assert [r.event_id for r in got2] == ["1", "2"]


def test_change_filter_nan(spark):
    df = _ot(spark, [1.0, float("nan"), 1.0, 2.0])
    got = _vals(C.only_on_change(df))
    assert got == [1.0, 2.0]
    assert _vals(C.deadband(df, 0.0)) == [1.0, 2.0]
    first_nan = _ot(spark, [float("nan"), 1.0, 2.0, "a", 3.0])
    got = _vals(C.only_on_change(first_nan))
    assert math.isnan(got[0]) and got[1:] == ["a", 3.0]
    assert len(_vals(C.deadband(first_nan, 0.0))) == 3


def test_change_filter_mixed_types(spark):
    df = _ot(spark, ["a", "a", 1.0, 1.0, "a", "b", "b"])
    assert _vals(C.only_on_change(df)) == ["a", 1.0, "a", "b"]
    assert _vals(C.deadband(df, 0.0)) == ["a", 1.0, "a", "b"]


def test_rate_cap(spark):
    base = dt.datetime(2024, 1, 1, 0, 0, 0)
    rows = [(str(i), base + dt.timedelta(milliseconds=m)) for i, m in
            enumerate([100, 200, 300, 1100])]
    df = spark.createDataFrame(rows, "event_id string, ingest_ts timestamp")
    assert sorted(r.event_id for r in C.rate_cap(df, 2).collect()) == ["0", "1", "3"]


def test_tag_provider(spark):
    df = spark.createDataFrame([("[opc]a",), ("[]a",), ("a",), ("[x]y]z",)], "p string")
    got = [r[0] for r in df.select(E.tag_provider("p")).collect()]
    assert got == ["opc", "default", "default", "x"]


def test_full_match_and_provider_filter(spark):
    df = spark.createDataFrame([("xa",), ("a",)], "tag_path string")
    assert [r.tag_path for r in S.select_pattern(df, "a").collect()] == ["a"]
    assert S.provider_filter(r"^\[(a|b)\]X/.*$") == ["a", "b"]
    assert S.provider_filter(r"^\[a.*\]X") is None


def test_folder_selection(spark):
    df = spark.createDataFrame([("[p]A/B/x",), ("[p]A/B/C/y",), ("[p]A/BB/z",)], "tag_path string")
    assert S.select_folder(df, "[p]A/B", recursive=False).count() == 1
    assert S.select_folder(df, "[p]A/B", recursive=True).count() == 2


def test_explicit_selection_trims_and_ignores_blanks(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "tag_path string")
    assert sorted(r.tag_path for r in S.select_explicit(df, [" a ", "", "c"]).collect()) == ["a", "c"]


def test_typed_value(spark):
    df = spark.createDataFrame([("1",), ("1.5",), ("true",), ('"a"',), ("null",), ("[1]",)],
                               "j string")
    tv = E.typed_value(F.parse_json("j"))
    got = [r[0] for r in df.select(tv["data_type"]).collect()]
    assert got == ["DOUBLE", "DOUBLE", "BOOLEAN", "STRING", "UNKNOWN", "UNKNOWN"]


def test_quality_fields(spark):
    df = spark.createDataFrame([("Good",), ("Bad",)], "q string")
    on = E.quality_fields("q", True)
    assert [tuple(r) for r in df.select(on["quality"], on["quality_code"]).collect()] == \
        [("Good", 192), ("Bad", 0)]
    off = E.quality_fields("q", False)
    assert [tuple(r) for r in df.select(off["quality"], off["quality_code"]).collect()] == \
        [("", 0), ("", 0)]


def test_normalize(spark):
    ev = spark.createDataFrame([
        (ts(), 1, "gw", "t1", 5.0, None, None, "Good", 192),
        (ts(), 1, "gw", "t2", None, None, True, "Good", 192),
        (ts(), 1, "gw", "t3", 7.0, None, None, "Good", 192)],
        "event_time timestamp, ingestion_timestamp long, source_system string, tag_path string, "
        "numeric_value double, string_value string, boolean_value boolean, quality string, "
        "quality_code int")
    m = spark.createDataFrame([("t1", "a1", "s1", "u", None, 2.0, True),
                               ("t2", "a1", "s2", "u", 3.0, 1.0, True),
                               ("t3", "a1", "s3", "u", 1.0, 0.0, False)],
                              "tag_path string, asset_id string, signal_name string, unit string, "
                              "scale double, offset double, active boolean")
    got = {r.tag_path: (r.signal_name, r.value_numeric) for r in V.normalize_events(ev, m).collect()}
    assert got == {"t1": ("s1", 7.0), "t2": ("s2", 1.0), "t3": (None, 7.0)}


def test_cycle_terminates(spark):
    par = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "node string, parent string")
    got = {r.node: r.path for r in G.ancestor_paths(par).collect()}
    assert len(got) == 3
    assert got["a"] == ["c", "b"]


def test_fault_impact(spark):
    df = spark.createDataFrame([("peeling", G.PROPAGATES, "washing"),
                                ("cutting", G.PROPAGATES, "peeling"),
                                ("frying", G.PROPAGATES, "other")], "s string, p string, o string")
    faulty = spark.createDataFrame([("washing",)], "node string")
    got = {(r.node, r.depth) for r in G.fault_impact(df, faulty).collect()}
    assert got == {("peeling", 1), ("cutting", 2)}


def test_episodes(spark):
    rows = [("a", ts(i), str(i), f) for i, f in enumerate([False, True, True, False, True])]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, id string, flag boolean")
    got = sorted(flag_intervals(df, ["asset"], "ts", "flag", tie=["id"]).collect(),
                 key=lambda r: r.start_ts)
    assert [(r.start_ts, r.end_ts, r.readings) for r in got] == [(ts(1), ts(3), 2), (ts(4), None, 1)]


def test_asof_join_includes_equal_time(spark):
    left = spark.createDataFrame([("k", ts(5)), ("k", ts(1)), ("j", ts(9))], "key string, ts timestamp")
    right = spark.createDataFrame([("k", ts(2), 1.0), ("k", ts(5), 2.0)],
                                  "key string, ts timestamp, v double")
    got = {(r.key, r.ts): r.v for r in asof_join(left, right, ["key"], "ts", ["v"]).collect()}
    assert got == {("k", ts(5)): 2.0, ("k", ts(1)): None, ("j", ts(9)): None}


def test_cpk(spark):
    df = spark.createDataFrame([(10.0 - 0.01,), (10.0,), (10.0 + 0.01,)], "v double")
    r = K.spc(df, [], "v", target=10.0, tol=0.03).collect()[0]
    assert r.cpk == pytest.approx(1.0)


def test_oee_and_scrap(spark):
    r = spark.range(1).select(K.oee(F.lit(90.0), F.lit(95.0), F.lit(98.0)).alias("o"),
                              K.scrap_rate(F.lit(0), F.lit(0)).alias("s")).collect()[0]
    assert round(r.o, 2) == 83.79 and r.s == 0.0


def test_power_curve_and_export(spark):
    df = spark.createDataFrame([(2.0,), (7.5,), (12.0,), (25.0,)], "v double")
    got = [r[0] for r in df.select(P.power_curve("v", 100.0, 3.0, 12.0, 25.0)).collect()]
    assert got == [0.0, 12.5, 100.0, 0.0]
    f = P.poi_flows(F.lit(100.0), 80.0, 25.0, F.lit(True))
    assert spark.range(1).select(f["export_kw"]).collect()[0][0] == 60.0


def test_iri_helpers(spark):
    import urllib.parse
    raw = ["<http://x.org/a b#c&amp;d>", " <http://x.org/a> ", "http://x.org/ü*~(x)"]
    df = spark.createDataFrame([(r,) for r in raw], "u string")
    want = [urllib.parse.quote(__import__("html").unescape(r).strip("<>").strip(),
                               safe=":/#?&=%@+") for r in raw]
    assert [r[0] for r in df.select(clean_uri("u")).collect()] == want
    assert want[0] == "http://x.org/a%20b#c&d"
    df2 = spark.createDataFrame([("http://x/component-12",), ("http://x/y#z/",)], "u string")
    assert [r[0] for r in df2.select(component_id_from_iri("u")).collect()][0] == "12"
    assert [r[0] for r in df2.select(local_name("u")).collect()] == ["component-12", "z"]


def test_soc_clamped(spark):
    from otgraph.operators.gold import bess_soc_clamped
    rows = [("b", ts(minutes=60 * i), v) for i, v in enumerate([0.0, -600.0, -600.0, 900.0])]
    df = spark.createDataFrame(rows, "k string, t timestamp, net double")
    got = [r.soc for r in bess_soc_clamped(df, "k", "t", "net", 1000.0).orderBy("t").collect()]
    # 50 → +60 (clamped to 95) → 95 → 95 − 90 = 5
    assert got == [50.0, 95.0, 95.0, 5.0]


def test_events_in_intervals_both_forms(spark):
    from otgraph.operators.gold import events_in_intervals
    ev = spark.createDataFrame([("a", ts(m), str(m)) for m in [0, 1, 5, 6, 9, 30]],
                               "k string, ts timestamp, id string")
    iv = spark.createDataFrame([("a", ts(1), ts(5)), ("a", ts(9), None), ("b", ts(0), ts(99))],
                               "k string, start_ts timestamp, end_ts timestamp")
    want = {("1", ts(1)), ("5", ts(1)), ("9", ts(9))}
    for disjoint in (True, False):
        got = {(r.id, r.start_ts) for r in
               events_in_intervals(ev, iv, ["k"], disjoint=disjoint).collect()}
        assert got == want


def test_map_ot_event_defaults(spark):
    from otgraph.sources.events import map_ot_event, parse_tag_payloads, payload_defaults
    lines = spark.createDataFrame(
        [('{"tagPath": "[p]A/x", "value": 2}',), ('[{"tagPath": "A/y", "value": "on", "quality": "Bad"}]',)],
        "line string")
    d = payload_defaults(parse_tag_payloads(lines), now=F.lit(T0).cast("timestamp"), source="direct")
    rows = {r.tag_path: r for r in map_ot_event(d, "gw", compat_defaults=True,
                                                  ingest_ts=F.lit(T0).cast("timestamp")).collect()}
    x, y = rows["[p]A/x"], rows["A/y"]
    assert (x.tag_provider, x.numeric_value, x.string_value, x.boolean_value, x.data_type) == \
        ("p", 2.0, "", False, "DOUBLE")
    assert (x.quality, x.quality_code, x.event_time) == ("UNKNOWN", 0, T0)
    assert (y.tag_provider, y.numeric_value, y.string_value, y.quality) == ("default", 0.0, "on", "Bad")
    plain = {r.tag_path: r for r in map_ot_event(d, "gw").collect()}
    assert plain["A/y"].numeric_value is None and plain["[p]A/x"].string_value is None


def test_default_event_id_is_stable(spark):
    from otgraph.sources.events import map_ot_event, parse_tag_payloads, payload_defaults
    lines = spark.createDataFrame([('{"tagPath": "a", "value": 1, "timestamp": 5}',)] * 2 +
                                  [('{"tagPath": "a", "value": 2, "timestamp": 5}',)], "line string")
    ev = map_ot_event(payload_defaults(parse_tag_payloads(lines)), "gw")
    ids = [r.event_id for r in ev.collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 36
    assert [r.event_id for r in ev.collect()] == ids
