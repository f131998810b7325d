import zlib

import numpy as np

from phonolake.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_folds(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_scores(docs, labels).toPandas()
    assert len(got) == docs.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95


def test_labels_of_fold_zero_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    a = quality.quality_scores(docs, labels).orderBy("doc_id").toPandas()
    b = quality.quality_scores(docs, turned).orderBy("doc_id").toPandas()
    assert np.allclose(a.score, b.score)


def test_edges(spark):
    schema = "doc_id long, text string, score double, label string"
    rows = [(1, "", None, None), (2, None, None, None), (None, "a b", None, None), (2, "word " * 50_000, 1.0, "x"), (3, "a b. C d!", None, None)]
    docs = spark.createDataFrame(rows, schema)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, one).collect()
    assert len(got) == 5 and all(r.predicted == 1 for r in got)
    assert quality.quality_scores(docs.limit(0), none).count() == 0
    assert quality.keep_quality(docs, one).columns == docs.columns


def test_pools():
    knots, values = quality.isotonic(np.array([1, 2, 0, 1]), np.array([1, 0, 0, 1]), np.array([0.0, 1, 2, 3]))
    assert values.tolist() == [1 / 3, 1.0] and knots.tolist() == [2 / 3, 3.0]
