"""Streaming: state across micro-batches, dedupe, observed metrics, latest snapshots."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from otgraph.sources.sinks import read_snapshot
from otgraph.streaming import ingest as S
from otgraph.streaming.stateful import deadband_stream

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)
SCHEMA = ("event_id string, event_time timestamp, tag_path string, numeric_value double, "
          "string_value string, boolean_value boolean, data_type string")


def _write(spark, d, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{d}/{name}")


def test_deadband_state_survives_micro_batches(spark):
    d = tempfile.mkdtemp(prefix="otgraph-st-")
    src = f"{d}/src"
    os.makedirs(src)
    mk = lambda i, v: (str(i), T0 + dt.timedelta(seconds=i), "t", v, None, None, "DOUBLE")
    _write(spark, src, [mk(0, 1.0), mk(1, 1.4)], "b1")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    out, ck = f"{d}/out", f"{d}/ck"
    q = S.write_append(deadband_stream(stream, 0.5), out, ck, available_now=True)
    q.awaitTermination()
    _write(spark, src, [mk(2, 1.8), mk(3, 3.0)], "b2")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = S.write_append(deadband_stream(stream, 0.5), out, ck, available_now=True)
    q.awaitTermination()
    got = sorted((r.event_time, r.numeric_value) for r in spark.read.parquet(out).collect())
    assert [v for _t, v in got] == [1.0, 1.8, 3.0]


def test_deadband_tags_share_state_rows(spark):
    """Many tags over micro-batches keep what the batch deadband keeps, with a state row per slot and not per tag."""
    import random
    from otgraph.operators.changes import deadband
    rng, d = random.Random(5), tempfile.mkdtemp(prefix="otgraph-st-")
    kinds = [("DOUBLE", 1.0, None, None), ("DOUBLE", 3.0, None, None), ("STRING", None, "x", None), ("BOOLEAN", None, None, True), ("UNKNOWN", None, None, None)]
    rows = []
    for i in range(240):
        kind, n, s_, b = rng.choice(kinds)
        rows.append((f"{i:04d}", T0 + dt.timedelta(seconds=i // 2), rng.choice([f"t{k}" for k in range(40)]), n, s_, b, kind))
    for k in range(3):
        _write(spark, d, rng.sample(rows[80 * k:80 * k + 80], 80), f"src/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{d}/src/*")
    q = S.write_append(deadband_stream(stream, 0.5, slots=4), f"{d}/out", f"{d}/ck", available_now=True)
    q.awaitTermination()
    got = sorted(r.event_id for r in spark.read.schema(SCHEMA).parquet(f"{d}/out").collect())
    assert got == sorted(r.event_id for r in deadband(spark.createDataFrame(rows, SCHEMA), 0.5).collect())
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_steps_of_a_fed_stream_have_as_many_files(spark, tmp_path, monkeypatch):
    from otgraph.plans import q_streaming as Q
    monkeypatch.setattr(Q, "_FILE_ROWS", 10, raising=False)
    parts = spark.range(400, numPartitions=1).withColumn("_f", F.col("id") % 4)
    write, files = Q._fed(parts, str(tmp_path))
    for f in range(4):
        write(f)
    assert files == 10
    assert [len([x for x in os.listdir(tmp_path / "in" / str(f)) if x.endswith(".parquet")]) for f in range(4)] == [10] * 4
    assert spark.read.parquet(f"{tmp_path}/in/*").agg(F.count_distinct("id")).first()[0] == 400


def test_dedupe_and_observe(spark):
    d = tempfile.mkdtemp(prefix="otgraph-st-")
    rows = [("e1", T0, "t", 1.0, None, None, "DOUBLE"), ("e1", T0, "t", 1.0, None, None, "DOUBLE"),
            ("e2", T0, "t", 2.0, None, None, "DOUBLE")]
    _write(spark, d, rows, "src")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{d}/src")
    obs = S.observe_ingest(stream.withColumn("quality", F.lit("Good")))
    q = (S.dedupe_events(obs, "10 minutes").writeStream.format("memory").queryName("dedupe_t")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(r.event_id for r in spark.sql("SELECT * FROM dedupe_t").collect()) == ["e1", "e2"]
    metrics = [p["observedMetrics"]["ingest"] for p in q.recentProgress
               if p.get("observedMetrics")]
    assert metrics and metrics[0]["received"] == 3 and metrics[0]["good"] == 3


def test_latest_stream_merges_batches(spark):
    d = tempfile.mkdtemp(prefix="otgraph-st-")
    ts = "s string, p string, o string, timestamp timestamp"
    spark.createDataFrame([("s", "p", "1", T0)], ts).write.parquet(f"{d}/src/a")
    stream = spark.readStream.schema(ts).option("maxFilesPerTrigger", 1).parquet(f"{d}/src/*")
    q = S.latest_stream(stream, f"{d}/snap", f"{d}/ck", available_now=True)
    q.awaitTermination()
    spark.createDataFrame([("s", "p", "2", T0 + dt.timedelta(minutes=1)), ("s", "q", "x", T0)], ts) \
        .write.parquet(f"{d}/src/b")
    stream = spark.readStream.schema(ts).option("maxFilesPerTrigger", 1).parquet(f"{d}/src/*")
    q = S.latest_stream(stream, f"{d}/snap", f"{d}/ck", available_now=True)
    q.awaitTermination()
    got = {(r.s, r.p): r.o for r in read_snapshot(spark, f"{d}/snap").collect()}
    assert got == {("s", "p"): "2", ("s", "q"): "x"}


def test_dedupe_restart_from_checkpoint(spark):
    """Stop the query, replay events into the source, restart from the checkpoint: nothing is
    lost and nothing is duplicated."""
    d = tempfile.mkdtemp(prefix="otgraph-st-")
    mk = lambda i: (f"e{i}", T0 + dt.timedelta(seconds=i), "t", float(i), None, None, "DOUBLE")
    _write(spark, f"{d}/src", [mk(0), mk(1)], "a")

    def run():
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{d}/src/*")
        q = S.write_append(S.dedupe_events(s, "1 hour"), f"{d}/out", f"{d}/ck", available_now=True)
        q.awaitTermination()

    run()
    _write(spark, f"{d}/src", [mk(1), mk(2)], "b")   # e1 replayed, e2 new
    run()
    got = sorted(r.event_id for r in spark.read.parquet(f"{d}/out").collect())
    assert got == ["e0", "e1", "e2"]


def test_stream_tag_payloads(spark):
    d = tempfile.mkdtemp(prefix="otgraph-st-")
    os.makedirs(f"{d}/in")
    with open(f"{d}/in/a.jsonl", "w") as f:
        f.write('{"tagPath": "[p]x", "value": 1.5, "quality": "Good", "timestamp": 1000}\n'
                'broken\n[{"tagPath": "y", "value": "on"}]\n')
    events, dead = S.stream_tag_payloads(spark, f"{d}/in")
    q1 = events.writeStream.format("memory").queryName("payload_ev").trigger(availableNow=True).start()
    q2 = dead.writeStream.format("memory").queryName("payload_dead").trigger(availableNow=True).start()
    q1.awaitTermination()
    q2.awaitTermination()
    assert sorted(r.tag_path for r in spark.sql("SELECT * FROM payload_ev").collect()) == ["[p]x", "y"]
    assert [r.line for r in spark.sql("SELECT * FROM payload_dead").collect()] == ["broken"]
