"""Small public helpers: ordering, unions, multi-target mapping, sensor aliasing, raw-payload
change filtering, payload files, N-Triples files, telemetry streams."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from otgraph.operators import changes as C
from otgraph.operators import triples as T
from otgraph.operators.mapping import TripleMapping, concat_batches, map_many
from otgraph.sources import events as E
from otgraph.sources import sinks, telemetry
from otgraph.streaming import ingest as S

T0 = dt.datetime(2024, 1, 1)


def test_small_helpers(spark):
    a = spark.createDataFrame([("s2", "p"), ("s1", "q"), ("s1", "p")], "s string, p string")
    assert [tuple(r) for r in T.order_by_component_property(a).collect()] == \
        [("s1", "p"), ("s1", "q"), ("s2", "p")]
    b = spark.createDataFrame([("x",)], "s string")
    assert concat_batches([a, b], allow_missing=True).count() == 4
    src = {"t1": spark.createDataFrame([("1", 5.0)], "id string, v double")}
    out = map_many(src, {"t1": TripleMapping(F.col("id"), {"pv": F.col("v")})})
    assert [tuple(r) for r in out["t1"].collect()] == [("1", "pv", "5.0")]
    w = spark.createDataFrame([(None, 2.0)], "oil double, water double")
    r = T.as_sensor_columns(w, {"A": "oil", "B": "water"}).collect()[0]
    assert (r.A, r.B) == (0.0, 2.0)


def test_change_filter_on_raw_variant_payloads(spark):
    lines = spark.createDataFrame(
        [(f'{{"tagPath": "t", "value": {v}, "timestamp": {i}}}',) for i, v in
         enumerate(["1", "1.0", '"1"', '"1"', "null", "null", "true", "2"])], "line string")
    p = E.parse_tag_payloads(lines).withColumn("event_time", F.timestamp_millis("timestamp_ms")) \
        .withColumn("event_id", F.col("timestamp_ms"))
    cols = C.change_columns_from_variant("value")
    kept = C.only_on_change(p, kind=cols["kind"], num=cols["num"], key=cols["key"])
    got = [r.timestamp_ms for r in kept.orderBy("timestamp_ms").collect()]
    # 1 → 1.0 is no change (numbers), "1" is a string, null once, true, 2
    assert got == [0, 2, 4, 6, 7]
    fold = C.deadband(p, 0.0, kind=cols["kind"], num=cols["num"], key=cols["key"])
    assert sorted(r.timestamp_ms for r in fold.collect()) == got


def test_payload_and_ntriples_files(spark):
    d = tempfile.mkdtemp(prefix="otgraph-h-")
    with open(os.path.join(d, "p.jsonl"), "w") as f:
        f.write('{"tagPath": "a", "value": 1}\nnot json\n[{"tagPath": "b", "value": 2}]\n')
    good, dead = E.split_corrupt(E.read_payload_lines(spark, d))
    assert dead.count() == 1
    assert sorted(r.tag_path for r in E.parse_tag_payloads(good, parsed="_v").collect()) == ["a", "b"]
    t = spark.createDataFrame([("http://x/a", "http://x/p", "v")], "s string, p string, o string")
    sinks.write_ntriples(t, d + "/nt")
    assert spark.read.text(d + "/nt").collect()[0].value == '<http://x/a> <http://x/p> "v" .'


def test_stream_telemetry_and_event_time(spark):
    d = tempfile.mkdtemp(prefix="otgraph-h-")
    raw = spark.createDataFrame([(1.0, "2024-01-01 10:00:00.250", "c1")],
                                "oil_temperature double, timestamp string, component_id string")
    telemetry.append_telemetry(telemetry.coerce_telemetry(raw), d + "/bronze")
    st = telemetry.with_event_time(S.stream_telemetry(spark, d + "/bronze"))
    q = st.writeStream.format("memory").queryName("telemetry_h").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.sql("SELECT * FROM telemetry_h").collect()[0]
    assert r.event_ts == dt.datetime(2024, 1, 1, 10, 0, 0, 250000) and r.abnormal_sensor == ""
