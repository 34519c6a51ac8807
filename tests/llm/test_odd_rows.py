"""Nulls, empty and very long texts, ties, repeated rows, clashing extra columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from otgraph.llm import decontam, html_text, lexical, line_dedup, lm_score, mixing, near_dup, packing, quality, runs, secrets, toxicity, warc

LONG = "a very long text of words that go on and on, " * 12_000          # over half a million characters
BLOB = "z" * 1_000_000
TEXTS = [None, "", " \n\t\n ", "one", "the same words here\nthe same words here", "the same words here\nthe same words here", LONG, LONG + "x", BLOB,
         "idiot\nidiot", "café ÉTÉ 漢字 😀", "password = abcdefghijkl1234"]
EXTRA = ("key", "h", "h2", "n", "size", "score", "first", "rank", "piece", "drop", "place", "block", "shard", "length", "start", "items", "spans", "hits",
         "unit", "part", "slots", "taken", "target", "component_id", "kept", "word", "_tk", "row", "own", "host", "path")


def _docs(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4]), (None, "null id"), (None, None), (3, "another text of the same id")]
    rows = [(d, t, "en", [None, "src0", "src1"][i % 3], len(t or "")) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in EXTRA}), rows


def _bench(spark):
    return spark.createDataFrame([(1, "the same words here"), (2, None), (None, "a very long text"), (1, "the same words here")], "item_id long, text string") \
        .withColumns({c: F.lit(1) for c in ("h", "block", "rank", "score", "term")})


def _labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "op1": lambda s, d: decontam.contamination(d, _bench(s)),
    "op2": lambda s, d: toxicity.score_documents(d, toxicity.train(d, _labels(s))),
    "op3": lambda s, d: line_dedup.dedup_lines(d),
    "op4": lambda s, d: secrets.scan_secrets(d),
    "op8": lambda s, d: near_dup.near_duplicates(d),
    "op9": lambda s, d: lm_score.score_documents(d, _labels(s).where("quality = 1")),
    "op10": lambda s, d: quality.judge(d, quality.train(d, _labels(s))),
    "op11": lambda s, d: runs.periodic_runs(d),
    "op12": lambda s, d: mixing.mix(d),
}


@pytest.mark.parametrize("op", OPERATORS)
def test_a_row_per_document(spark, op):
    df, rows = _docs(spark)
    got = OPERATORS[op](spark, df).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in rows), key=str)
    if op != "op12":                                     # a mix may take equal rows unequally often
        twins = [tuple(r) for r in got if r["doc_id"] == 4]
        assert len(twins) == 2 and str(twins[0]) == str(twins[1])
    assert OPERATORS[op](spark, df.limit(0)).count() == 0


def test_packing_search_and_texts_of_odd_rows(spark):
    df, rows = _docs(spark)
    pieces = packing.pack(df).collect()
    assert {r["doc_id"] for r in pieces} == {r[0] for r in rows}
    found = lexical.search(df, _bench(spark)).collect()
    assert sorted(r["doc_id"] for r in found if r["item_id"] == 1)[:3] == [3, 4, 4] or len(found) > 3
    assert sorted(r["rank"] for r in found if r["item_id"] == 1) == list(range(1, 1 + sum(r["item_id"] == 1 for r in found)))
    assert mixing.mixed_texts(df).where("text = ''").count() == 0
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.where("doc_id = 4").count() <= 1


def test_pages(spark):
    long = "<article>" + "<p>paragraph of text</p>" * 40_000 + "</article>"
    rows = [(1, "http://a.org/1", long), (2, "http://a.org/1", long), (2, "http://a.org/1", long), (3, None, None), (4, "", ""), (None, "x", "<p>y"), (5, "http://[", "<" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in EXTRA})
    got = {(r["page_id"], r["n_chars"]) for r in html_text.extract_text(df).collect()}
    assert (3, 0) in got and (4, 0) in got and (None, 1) in got and len({n for p, n in got if p in (1, 2)}) == 1
    back = warc.round_trip(df.where("page_id is not null").dropDuplicates(["page_id"])).collect()
    assert sorted(r["page_id"] for r in back) == [1, 2, 3, 4, 5]
    assert html_text.extract_text(df.limit(0)).count() == 0 and warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in P.STAGES])
def test_stages_of_odd_rows(spark, stage, tmp_path):
    df, rows = _docs(spark)
    _bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    run = dict(P.STAGES)[stage]
    out = run(spark, df, str(tmp_path))
    if stage != P.STAGES[-1][0]:
        assert out.columns == df.columns
    assert {r["doc_id"] for r in out.select("doc_id").collect()} <= {r[0] for r in rows} and out.count() > 0
    assert run(spark, df.limit(0), str(tmp_path)).count() == 0


def test_a_written_table_leaves_no_shuffle_behind(spark):
    from pyspark.sql import functions as F

    from otgraph.llm.common import shuffles_dropped, written
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in manager.getAllFiles().mkString("\n").split("\n") if x.endswith(".data") and "shuffle_" in x}
    before, conf = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with shuffles_dropped(spark):
        out = written(spark.range(1000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count(), "test")
    assert not files() - before and out.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == conf
