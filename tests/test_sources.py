"""Readers and writers: tag trees, Turtle, catalogue, bronze round trips, snapshots, dims."""

import os
import tempfile

from pyspark.sql import functions as F

from otgraph.operators import graph as G
from otgraph.sources import dims, files, sinks, telemetry

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def _tmp():
    return tempfile.mkdtemp(prefix="otgraph-test-")


def test_tag_tree_leaves(spark):
    df = files.load_tag_tree(spark, {"site": os.path.join(FIX, "site_tags.json")})
    got = {r.tag_path: (r.data_type, r.value) for r in df.collect()}
    assert got == {
        "[site]Plant/Mode": ("String", '"AUTO"'),
        "[site]Plant/Line1/Speed": ("Float4", "1.5"),
        "[site]Plant/Line1/Running": ("Boolean", "true"),
        "[site]Plant/Line1/Fryer/OilTemp": ("Float4", "178"),
        "[site]Plant/Line1/Fryer/Count": ("Int4", "0"),
    }


def test_turtle_subset(spark):
    df = files.load_turtle(spark, os.path.join(FIX, "mini_plant.ttl"))
    rows = {(r.s.split("/")[-1], r.p.split("/")[-1].split("#")[-1], r.o, r.o_type)
            for r in df.collect()}
    assert ("Peeling", "ratedSpeed", "1.2", "http://www.w3.org/2001/XMLSchema#float") in rows
    assert ("Cutting", "propagates", "http://example.com/mini/Washing", "iri") in rows
    assert ("Cutting", "blades", "4", "http://www.w3.org/2001/XMLSchema#integer") in rows
    assert ("Peeling", "comment", 'Peels, "gently"', "literal") in rows
    assert ("Line1", "rdf:type", "http://example.com/mini/Line", "iri") in rows
    # the loaded model feeds the graph operators
    parents = {r.node.split("/")[-1]: r.parent.split("/")[-1]
               for r in G.parents(df.select("s", "p", "o")).collect()}
    assert parents == {"Washing": "Line1", "Peeling": "Line1", "Cutting": "Line1"}
    faulty = spark.createDataFrame([("http://example.com/mini/Washing",)], "node string")
    hit = {(r.node.split("/")[-1], r.depth) for r in G.fault_impact(df, faulty).collect()}
    assert hit == {("Peeling", 1), ("Cutting", 1)}


TURTLE = """@prefix ex: <http://e/> . # first . prefix
ex:a a ex:T ; ex:label "one. \\"two\\" # no comment" ;
  ex:note \"\"\"long
text. with "quotes" and # signs
@prefix ex: <http://wrong/> .
end\"\"\" , "short"@en .
# a comment with \"\"\" in it.
<http://x/b.c#d> ex:v 1.5 , -2 , true .
@prefix ex: <http://later/> .
@prefix o: <http://o/> .
ex:a o:p.q ex:z .
o:last ex:note \"\"\"a
b\"\"\"^^ex:md .
"""


def test_turtle_in_ranges_equals_a_single_read(spark):
    import random
    d = _tmp()
    rng = random.Random(1)
    texts = {"one.ttl": TURTLE, "empty.ttl": "", "comment.ttl": "# nothing\n", "noend.ttl": TURTLE.rstrip()}
    parts = TURTLE.split("\n")
    texts["many.ttl"] = "".join(TURTLE.replace("ex:a", f"ex:a{i}").replace("later", f"later{i}") + "\n" * rng.randrange(3) for i in range(30))
    texts["open.ttl"] = "\n".join(["@prefix ex: <http://e/> ."] + ['ex:s ex:p """' + "\n".join(f"line {i}. <x> #" for i in range(60)) + '""" .'] * 3 + parts[:2]) + " ex:q 1 .\n"
    for name, text in texts.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    want = sorted(r for name, text in texts.items() for r in files.parse_turtle(text, name))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for chunk, split in ((1, "300b"), (200, "1k"), (1 << 20, "128m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            got = sorted((r[0].split("/")[-1], *r[1:]) for r in map(tuple, files.load_turtle(spark, f"{d}/*.ttl", chunk_chars=chunk).collect()))
            assert got == want, (chunk, split)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert any(r[2] == "http://o/p.q" for r in want) and any(r[1].startswith("http://later") for r in want)


def test_template_catalog(spark):
    d = _tmp()
    with open(os.path.join(d, "oil_rig_template.ttl"), "w") as f:
        f.write("@prefix ex: <http://e/> .\n# This prefix is skipped\n# Offshore rig model\nex:a ex:b ex:c .\n")
    with open(os.path.join(d, "small_factory.ttl"), "w") as f:
        f.write("ex:a ex:b ex:c .\n")
    got = {r.filename: (r.name, r.description, r.category)
           for r in files.ttl_template_catalog(spark, d).collect()}
    assert got == {"oil_rig_template.ttl": ("Oil Rig Template", "Offshore rig model", "oil-gas"),
                   "small_factory.ttl": ("Small Factory", "Local TTL file template", "manufacturing")}


def test_bronze_round_trip_and_partial(spark):
    d = _tmp() + "/bronze"
    raw = spark.createDataFrame(
        [(1.0, "2024-01-01 10:00:00.123", 7, "Frying", 1, None, 1)],
        "oil_temperature double, timestamp string, component_id int, stage_id string, "
        "damaged_component int, abnormal_sensor string, line_id int")
    telemetry.append_telemetry(telemetry.coerce_telemetry(raw), d)
    part = spark.createDataFrame([("c2", "1", "Washing", 1.0, 2.0, 3.0, 4.0, "2024-01-01 10:00:01.000")],
                                 "component_id string, line_id string, stage_id string, "
                                 "oil_temperature double, water_temperature double, belt_speed double, "
                                 "freezer_temperature double, timestamp string")
    telemetry.append_partial(part, d)
    back = telemetry.read_telemetry(spark, d)
    assert back.count() == 2
    r = back.filter("component_id = '7'").collect()[0]
    assert r.damaged_component is True and r.abnormal_sensor == ""
    r2 = back.filter("component_id = 'c2'").collect()[0]
    assert r2.moisture_content is None and r2.belt_speed == 3.0
    triples = telemetry.telemetry_mapping().apply(back)
    # rows + non-null mapped cells
    assert triples.count() == 2 + 3 + 4
    assert triples.filter(F.col("timestamp").isNull()).count() == 0


def test_legacy_csv(spark):
    df = telemetry.read_legacy_csv(spark, os.path.join(FIX, "legacy.csv"))
    assert df.count() == 2 and df.filter("damaged_component").count() == 1


def test_snapshot_versions(spark):
    base = _tmp() + "/latest"
    t = spark.createDataFrame([("s", "p", "1", None)], "s string, p string, o string, timestamp timestamp")
    sinks.sync_latest(t, base, version="1")
    sinks.sync_latest(t.union(t), base, version="2")
    assert sinks.read_snapshot(spark, base).count() == 1


def test_ntriples(spark):
    t = spark.createDataFrame([("http://x/a", "rdf:type", "http://x/T"), ("http://x/a", "http://x/p", 'say "hi"')],
                              "s string, p string, o string")
    lines = sorted(r.value for r in sinks.ntriples_lines(t).collect())
    assert lines == ['<http://x/a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x/T> .',
                     '<http://x/a> <http://x/p> "say \\"hi\\"" .']


def test_dims(spark):
    eq = dims.equipment_dim(spark)
    assert eq.count() == 16
    r = eq.filter("component_id = 'HB-SHRED'").collect()[0]
    assert (r.line_id, r.stage_id, r.line_name) == ("2", "2-3", "Hash Browns")
    prof = dims.sensor_profile_dim(spark)
    assert prof.count() == 54
    st = spark.createDataFrame([("Frying",), ("Unknown",)], "stage_name string")
    got = {(r.stage_name, r.sensor): r.base for r in dims.profiles_for(st, prof).collect()}
    assert got[("Frying", "oil_temperature")] == 178.0
    assert got[("Unknown", "oil_temperature")] == 20.0 and got[("Unknown", "product_weight")] == 500.0


def test_partitioned_triples_prune_days(spark):
    import datetime as dt
    from otgraph.operators.triples import point_in_time
    d = _tmp() + "/triples"
    t0 = dt.datetime(2024, 1, 1, 12)
    rows = [("s", "p", str(i), t0 + dt.timedelta(days=i)) for i in range(5)]
    sinks.write_triples(spark.createDataFrame(rows, "s string, p string, o string, timestamp timestamp"), d)
    back = spark.read.parquet(d)
    pit = point_in_time(back, "2024-01-03 00:00:00")
    assert [r.o for r in pit.collect()] == ["1"]
    plan = pit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "date#" in plan


def test_turtle_triples_leave_in_frames_of_bounded_size(monkeypatch):
    import pandas as pd
    monkeypatch.setattr(files, "ROWS_OUT", 4, raising=False)
    texts = ["".join(f"<s{i}> <p> <o{j}> .\n" for j in range(5)) for i in range(3)]
    frames = list(files._parsed([pd.DataFrame({"graph": "g", "text": texts, "known": None})]))
    assert max(map(len, frames)) <= 4
    assert [tuple(r) for f in frames for r in f[["s", "o"]].itertuples(index=False)] == [(f"s{i}", f"o{j}") for i in range(3) for j in range(5)]
