import corpus_pipeline
from phonolake.llm import quality

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = [set(before)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= seen[-1] and docs.count() == len(rows), name
        assert name == "encoding" or docs.columns == columns
        if name == "quality":
            scores = quality.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(rows) == {r.doc_id for r in scores.where("predicted = 1").collect()}
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in rows.values()) and set(rows) == seen[-1]
        seen.append(set(rows))
    assert len(seen[-1]) > 0.4 * len(before)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == seen[-1]


def test_empty_and_odd_rows(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a. " * 60_000, "en", "s", 1), (2, "a. " * 60_000, "en", "s", 1)]
    for odd in ([], rows):
        docs = spark.createDataFrame(odd, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.count() <= len(odd)
