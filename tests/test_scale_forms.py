"""Forms made for size against their plain ones: dyadic pieces, trigram postings, chained states, metric folders."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from otgraph.operators import models as M
from otgraph.operators import silver as V
from otgraph.operators.gold import dyadic_pieces, events_in_intervals
from otgraph.sources.model_index import ModelIndex
from otgraph.streaming import ingest as S
from otgraph.streaming.metrics import MetricsListener, read_metrics, total_metrics

T0 = dt.datetime(2024, 1, 1)


def test_dyadic_pieces_cover_each_cell_once(spark):
    rng = random.Random(1)
    spans = [(a, a + n) for a in (-70, -1, 0, 5, 1023) for n in (1, 2, 3, 7, 64, 1000)] + [(a := rng.randrange(-10**6, 10**6), a + rng.randrange(1, 5000)) for _ in range(30)]
    rows = spark.createDataFrame(spans, "a long, e long").select("a", "e", dyadic_pieces(F.col("a"), F.col("e")).alias("p")).collect()
    for r in rows:
        cells = sorted(c for p in r["p"] for c in range(p["c"] << p["k"], p["c"] + 1 << p["k"]))
        assert cells == list(range(r["a"], r["e"]))
        scales = [p["k"] for p in r["p"]]
        assert all(scales.count(k) <= 2 for k in scales)


def test_overlapping_and_long_intervals(spark):
    rng = random.Random(2)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(20 * 86400))
    ev = [(rng.choice(["a", "b", None]), at(), i) for i in range(150)]
    iv = [(rng.choice(["a", "b", "c", None]), s := at(), rng.choice([None, s - dt.timedelta(1), s + dt.timedelta(seconds=rng.choice([0, 50, 4000, 10**6, 10**9]))]), i) for i in range(40)]
    e = spark.createDataFrame(ev + [("a", iv[0][1], 999)], "k string, ts timestamp, id long")
    w = spark.createDataFrame(iv, "k string, start_ts timestamp, end_ts timestamp, name long")
    want = {(i, n) for k, t, i in [tuple(r) for r in e.collect()] for q, s, x, n in iv if k is not None and k == q and s <= t <= (x or s)}
    for cell in (60, 3600, 10**6):
        got = [(r["id"], r["name"]) for r in events_in_intervals(e, w, ["k"], disjoint=False, bucket_seconds=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_repeated_events_are_not_broadcast(spark):
    e = spark.createDataFrame([("a", T0 + dt.timedelta(hours=i), i) for i in range(9)], "k string, ts timestamp, id long")
    w = spark.createDataFrame([("a", T0, T0 + dt.timedelta(days=9), 1)], "k string, start_ts timestamp, end_ts timestamp, name long")
    out = events_in_intervals(e, w, ["k"], disjoint=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and out.count() == 9


def test_indexed_search_equals_the_scan(spark):
    rng = random.Random(3)
    voc = ["pump", "Pumpe", "Kühler", "ÄRGER", "a%b", "x_y", "line\nbreak", "日本語", "fan", "pu", "\\"]
    rows = [(i, f"m{i}", rng.choice([None, " ".join(rng.choices(voc, k=3))]), rng.choice("AB"), rng.choice([None, "", " ".join(rng.choices(voc, k=rng.randrange(9)))])) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, name string, description string, category string, content string")
    index = ModelIndex(spark, tempfile.mkdtemp(prefix="otgraph-ix-"), buckets=8, parts=4).build(df)
    for text in ("pump", "KÜHLER", "ärger", "日本語", "fan pu", "e\nb", "a%b", "pu%an", "x_y", "pu", "absent words", "m11"):
        for category in (None, "A"):
            got = sorted(r["id"] for r in index.search(text, category).select("id").collect())
            assert got == sorted(r["id"] for r in M.search_models(df, category, text).select("id").collect()), text
    assert index.candidates("pu") is None and index.candidates("absent words").count() == 0
    plan = index.candidates("Kühler")._jdf.queryExecution().executedPlan().toString()
    assert "/postings]" in plan and "/models]" not in plan                          # postings, no model text
    assert "PartitionFilters: [bucket#" in plan and "PushedFilters: [In(gram" in plan


def test_chained_states_equal_direct_rollups(spark):
    rng = random.Random(4)
    rows = [(T0 + dt.timedelta(seconds=rng.randrange(3 * 86400)), rng.choice("ab"), "s", rng.choice([None, float(rng.randrange(100))]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "event_time timestamp, asset_id string, signal_name string, value_numeric double, ingestion_timestamp long")
    states = V.rollup_chain(df, ["1 minute", "5 minutes", "1 hour", "1 day"])
    for size, state in states.items():
        got = sorted(map(tuple, V.rollup_values(state).collect()))
        assert got == sorted(map(tuple, V.rollup_signals(df, size).collect())), size


def test_metrics_are_written_once_per_epoch(spark):
    base = tempfile.mkdtemp(prefix="otgraph-me-")
    schema = "event_id long, quality string, over boolean"
    rows = [(i, ["Good", "BAD", None][i % 3], i % 5 == 0) for i in range(60)]
    listener = MetricsListener(spark, f"{base}/m")
    spark.streams.addListener(listener)
    try:
        for run in range(2):
            spark.createDataFrame(rows[run * 30:run * 30 + 30], schema).coalesce(1).write.parquet(f"{base}/in/{run}")
            stream = S.observe_ingest(spark.readStream.schema(schema).parquet(f"{base}/in/*"), dropped="over")
            q = S.write_append(stream, f"{base}/out", f"{base}/ck", available_now=True)
            q.awaitTermination()
            listener.flush(q)
            for p in q.recentProgress:                      # delivered again: the same rows
                listener.onQueryProgress(type("E", (), {"progress": p}))
    finally:
        spark.streams.removeListener(listener)
    t = total_metrics(read_metrics(spark, f"{base}/m")).collect()
    assert [(r["received"], r["good"], r["dropped"], r["filtered"], r["accepted"], r["epochs"]) for r in t] == [(60, 20, 12, 0, 48, 2)]
