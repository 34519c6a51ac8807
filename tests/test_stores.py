"""Tables kept current by commits: the bucketed latest store and the history with day checkpoints."""

import datetime as dt
import random
import tempfile

import pytest

from otgraph.operators.triples import latest_triples, point_in_time
from otgraph.sources.history import DAY, STATE, TripleHistory
from otgraph.sources.latest_store import BASE, DELTA, LatestStore
from otgraph.sources.versions import File, Versions
from otgraph.streaming import ingest as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "s string, p string, o string, timestamp timestamp"


def _rows(rng, n, lo=0, hi=9 * 86400, subjects=8):
    return [(rng.choice([None, *"abcdefgh"[:subjects]]), rng.choice("pq"), rng.choice([None, "1", "2", "3"]),
             T0 + dt.timedelta(seconds=rng.randrange(lo, hi) // 3600 * 3600)) for _ in range(n)]


def _set(df):
    return sorted((tuple(r) for r in df.select("s", "p", "o", "timestamp").collect()), key=str)


def test_store_equals_latest_over_many_batches(spark):
    rng = random.Random(1)
    store = LatestStore(spark, tempfile.mkdtemp(prefix="otgraph-ls-"), buckets=4)
    seen = []
    for _ in range(6):
        batch = _rows(rng, 40)
        seen += batch
        store.merge(spark.createDataFrame(batch, SCHEMA))
        assert _set(store.read()) == _set(latest_triples(spark.createDataFrame(seen, SCHEMA)))
    assert _set(store.lookup(s="a")) == _set(latest_triples(spark.createDataFrame(seen, SCHEMA)).where("s = 'a'"))
    assert _set(store.lookup(s=None)) == _set(latest_triples(spark.createDataFrame(seen, SCHEMA)).where("s is null"))
    assert store.lookup(s="unknown").count() == 0
    n = store.versions.number()
    store.merge(spark.createDataFrame([], SCHEMA))                       # an empty batch
    assert store.versions.number() == n + 1 and _set(store.read()) == _set(store.read(n))


def test_a_batch_writes_only_the_buckets_it_touches(spark):
    store = LatestStore(spark, tempfile.mkdtemp(prefix="otgraph-ls-"), buckets=16, share=0.5)
    old = [(f"s{i}", p, "0", T0) for i in range(200) for p in "pqrstu"]
    store.merge(spark.createDataFrame(old, SCHEMA))
    before = {f.part: f for f in store.versions.files()}
    assert len(before) == 16 and all(f.kind == BASE for f in before.values())
    late = lambda k: spark.createDataFrame([("s7", "p", str(k), T0 + dt.timedelta(days=k))], SCHEMA)
    assert store.merge(late(1)) == []
    now = store.versions.files()
    new = [f for f in now if f not in before.values()]
    assert len(new) == 1 and new[0].kind == DELTA and new[0].rows == 1
    part = new[0].part
    written = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
               .load(f"{store.versions.base}/data/{store.versions.number():012d}-*").select("path").collect()]
    assert written and all(f"hash_bucket={part}/" in w for w in written)  # no other bucket has a new file
    k = 2
    while not (due := store.merge(late(k))):
        k += 1
    assert due == [part] and k > before[part].rows * 0.5                  # deltas outgrew their share of the base
    after = store.versions.files()
    assert [f for f in after if f.part != part] == [f for f in now if f.part != part]
    assert [f.kind for f in after if f.part == part] == [BASE]
    assert store.lookup(s="s7").where("p = 'p'").first()["o"] == str(k)
    assert all(f"hash_bucket={part}/" in x for x in store.lookup(s="s7").inputFiles())


def test_replayed_epochs_and_rival_writers(spark):
    store = LatestStore(spark, tempfile.mkdtemp(prefix="otgraph-ls-"), buckets=2)
    row = spark.createDataFrame([("a", "p", "1", T0)], SCHEMA)
    store.merge(row, "x", 0)
    store.merge(spark.createDataFrame([("a", "p", "2", T0)], SCHEMA), "x", 1)
    n = store.versions.number()
    assert store.merge(row, "x", 1) == [] and store.versions.number() == n
    store.merge(row, "y", 0)                                              # another origin counts for itself
    assert store.versions.number() == n + 1
    v = Versions(spark, store.versions.base)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        v.commit(n, [File("base", "0", "x", 1)])                          # started from an older commit
    with pytest.raises(FileNotFoundError):
        LatestStore(spark, tempfile.mkdtemp(prefix="otgraph-ls-")).read()


def test_store_fed_by_a_stream_with_restart(spark):
    rng = random.Random(3)
    base = tempfile.mkdtemp(prefix="otgraph-ls-")
    seen, store = [], LatestStore(spark, f"{base}/t", buckets=4)
    for k in range(3):
        for j in range(2):
            batch = _rows(rng, 30)
            seen += batch
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(f"{base}/in/{k}{j}")
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
        S.latest_store_stream(src, store, f"{base}/ck", available_now=True).awaitTermination()
    assert _set(store.read()) == _set(latest_triples(spark.createDataFrame(seen, SCHEMA)))
    assert store.versions.number() == 6


@pytest.mark.parametrize("every", [1, 3])
def test_history_equals_point_in_time(spark, every):
    rng = random.Random(every)
    h = TripleHistory(spark, tempfile.mkdtemp(prefix="otgraph-h-"), every=every)
    seen = []
    day = 86400
    # in order, a gap, late ones before and among the others, more at the end
    for lo, hi in ((2 * day, 5 * day), (9 * day, 10 * day), (0, 4 * day), (9 * day, 12 * day)):
        batch = _rows(rng, 60, lo, hi)
        seen += batch
        h.append(spark.createDataFrame(batch, SCHEMA))
        all_ = spark.createDataFrame(seen, SCHEMA)
        for hours in (72, 181, 240):
            at = T0 + dt.timedelta(hours=hours)
            assert _set(h.at(at)) == _set(point_in_time(all_, at)), (lo, hours)
        assert _set(h.latest()) == _set(latest_triples(all_))
    h.append(spark.createDataFrame([("z", "p", "1", None)], SCHEMA))      # no time: no place in the history
    assert h.latest().where("s = 'z'").count() == 0


def test_history_reads_one_checkpoint_and_one_day(spark):
    rng = random.Random(5)
    h = TripleHistory(spark, tempfile.mkdtemp(prefix="otgraph-h-"))
    h.append(spark.createDataFrame(_rows(rng, 400), SCHEMA))
    df = h.at("2024-01-06 12:00:00")
    folders = {f.rsplit("/", 2)[1] for f in df.inputFiles()}
    assert folders == {"asof=2024-01-06", "date=2024-01-06"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "PartitionFilters: [isnotnull(asof" in plan
    states = [f for f in h.versions.files() if f.kind == STATE]
    h.append(spark.createDataFrame([("a", "p", "9", T0 + dt.timedelta(days=9, hours=1))], SCHEMA))
    kept = [f for f in h.versions.files() if f.kind == STATE]
    assert set(states) <= set(kept) and len(kept) == len(states) + 1      # a new day rewrites no checkpoint
    assert len(h.days()) == 10 and sum(f.rows for f in h.versions.files() if f.kind == DAY) == 401
    assert h.at("2023-12-01 00:00:00").count() == 0
