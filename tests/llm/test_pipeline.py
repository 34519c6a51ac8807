import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, sizes = docs, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        now = P.written(stage(spark, now, SF), "test")
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    packed = P.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_run_equals_the_stages(spark):
    assert P.run(spark, SF).count() > 0
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "packing"]
