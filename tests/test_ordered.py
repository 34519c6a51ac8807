"""The deadband of events out of order: equal to the batch deadband, with little state."""

import datetime as dt
import random
import tempfile

from otgraph.operators.changes import deadband
from otgraph.streaming import ingest as S
from otgraph.streaming.ordered import last_kept, ordered_deadband_stream

T0 = dt.datetime(2024, 1, 1)
SCHEMA = ("event_id string, event_time timestamp, tag_path string, numeric_value double, "
          "string_value string, boolean_value boolean, data_type string")


def _events(rng, n, start=0):
    out = []
    for i in range(start, start + n):
        kind = rng.choice(["DOUBLE"] * 6 + ["STRING", "BOOLEAN", "UNKNOWN"])
        out.append((f"{i:05d}", T0 + dt.timedelta(seconds=i), rng.choice("ab"), float(rng.randrange(8)) if kind == "DOUBLE" else None,
                    rng.choice("xy") if kind == "STRING" else None, rng.random() < .5 if kind == "BOOLEAN" else None, kind))
    return out


def _shuffled(rng, rows, within):
    return sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(within)))


def _run(spark, base, name, batches, **kw):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{base}/in{name}/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in{name}/*")
    q = S.write_append(ordered_deadband_stream(stream, 1.0, "20 seconds", **kw), f"{base}/out{name}", f"{base}/ck{name}", available_now=True)
    q.awaitTermination()
    return {r["event_id"] for r in spark.read.schema(SCHEMA).parquet(f"{base}/out{name}").collect()}, q


def _kept(spark, rows):
    return {r["event_id"] for r in deadband(spark.createDataFrame(rows, SCHEMA), 1.0).collect()}


def test_shuffled_batches_equal_the_batch_deadband_and_go_on_from_it(spark):
    rng = random.Random(1)
    base = tempfile.mkdtemp(prefix="otgraph-or-")
    rows = _events(rng, 160)
    end = ("99999", T0 + dt.timedelta(days=1), "end", 0.0, None, None, "DOUBLE")        # lets the watermark pass all others
    mixed = _shuffled(rng, rows, 15)
    got, q = _run(spark, base, "a", [mixed[:50], mixed[50:100], mixed[100:], [end]])
    assert got - {"99999"} == _kept(spark, rows)
    # nothing is left waiting but the closing event and a value per tag
    assert sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"]) < 40
    first, rest = rows[:80], rows[80:]
    again, _ = _run(spark, base, "b", [_shuffled(rng, rest, 15), [end]], initial=last_kept(spark.createDataFrame(first, SCHEMA), 1.0))
    assert again - {"99999"} == _kept(spark, rows) - {r[0] for r in first}


def test_tags_share_state_rows(spark):
    rng = random.Random(6)
    base = tempfile.mkdtemp(prefix="otgraph-or-")
    rows = [(*r[:2], f"t{rng.randrange(30)}", *r[3:]) for r in _events(rng, 120)]
    end = ("99999", T0 + dt.timedelta(days=1), "end", 0.0, None, None, "DOUBLE")
    mixed = _shuffled(rng, rows, 15)
    got, q = _run(spark, base, "d", [mixed[:60], mixed[60:], [end]], slots=4)
    assert got - {"99999"} == _kept(spark, rows)
    # of each slot the last values, the mark of its last fold and blocks of waiting events
    assert sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"]) <= 16


def test_silent_tags_are_forgotten(spark):
    base = tempfile.mkdtemp(prefix="otgraph-or-")
    at = lambda s: T0 + dt.timedelta(seconds=s)
    ev = lambda i, s, tag="a": (i, at(s), tag, 5.0, None, None, "DOUBLE")
    got, _ = _run(spark, base, "c", [[ev("0", 0), ev("1", 30)], [ev("2", 500)], [ev("z", 9000, "end")]], expire_ms=100_000)
    assert got - {"z"} == {"0", "2"}                                         # the value is the same, but the tag was silent for long


def test_rate_cap_counts_over_micro_batches(spark):
    from otgraph.streaming.ordered import rate_cap_stream
    base = tempfile.mkdtemp(prefix="otgraph-rc-")
    schema = "event_id string, ingest_ts timestamp, source_system string"
    at = lambda i, s, g="g": (i, T0 + dt.timedelta(seconds=s), g)
    batches = [[at("a", 0), at("c", 0.5), at("b", 0.5), at("x", 0, "h")], [at("d", 0.9), at("e", 1.0), at("f", 1.5), at("g", 1.7)], [at("h", 9000)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    q = S.write_append(rate_cap_stream(stream, 2), f"{base}/out", f"{base}/ck", available_now=True)
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.schema(schema).parquet(f"{base}/out").collect()) == ["a", "b", "e", "f", "h", "x"]
    assert sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"]) <= 6        # passed seconds are forgotten
