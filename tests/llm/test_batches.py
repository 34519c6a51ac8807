import pyarrow as pa
from pyspark.sql import functions as F

from otgraph.llm import lm_score

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_lm_texts_reach_workers_in_small_batches(spark, monkeypatch):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(4000, numPartitions=1).select("id", F.repeat(F.lit("x"), 4000).alias("text"))
    before, seen = spark.conf.get(SETTING), {}

    def spy(df, kind, f=lm_score.written):
        if kind not in seen:
            seen[kind] = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
        return f(df, kind)

    monkeypatch.setattr(lm_score, "written", spy)
    docs = spark.createDataFrame([(1, "a b c"), (2, "b c")], "doc_id long, text string")
    assert lm_score.score_documents(docs, docs.where("doc_id = 1")).count() == 2
    assert set(seen) == {"lm-units", "lm-sums"} and all(max(x) < 3 << 20 for x in seen.values())
    assert spark.conf.get(SETTING) == before
