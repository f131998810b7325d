import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from phonolake.functions.hashing import hash_bits, hash_unit
from phonolake.operators import positions as O
from phonolake.operators import sampling as S
from phonolake.operators.pairs import grouped_index


def bits(seed, *ids):
    return int(hashlib.md5(":".join([str(seed), *map(str, ids)]).encode()).hexdigest()[:8], 16)


def frame(spark, n=300, parts=5):
    return spark.range(n).withColumn("label", (F.col("id") % 7 % 3).cast("int")).repartition(parts)


def test_hash_is_portable(spark):
    got = spark.range(50).select(hash_bits(42, "id"), hash_unit(42, "id")).collect()
    assert sorted(r[0] for r in got) == sorted(bits(42, i) for i in range(50))
    assert all(r[1] == r[0] / 2**32 for r in got)


def test_dense_index_on_sparse_ids(spark):
    draw = random.Random(1)
    ids = sorted({draw.randrange(-(2**62), 2**62) for _ in range(200)} | set(range(50)) | {2**20, 2**20 - 1, 2**40, -1})
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    got = {r["id"]: r["pos"] for r in O.dense_index(df, "id").collect()}
    assert got == {i: p for p, i in enumerate(ids)}


@pytest.mark.parametrize("parts", [1, 6])
def test_shuffled_index_with_groups_and_total(spark, parts):
    rows = O.shuffled_index(frame(spark, parts=parts), 3, ["id"], groups=["label"], total="n").collect()
    for label in range(3):
        mine = sorted((r["pos"], r["id"]) for r in rows if r["label"] == label)
        want = sorted((i for i in range(300) if i % 7 % 3 == label), key=lambda i: (bits(3, i), i))
        assert [i for _, i in mine] == want and [p for p, _ in mine] == list(range(len(want)))
        assert {r["n"] for r in rows if r["label"] == label} == {len(want)}


def test_grouped_index_with_one_hot_group(spark):
    df = spark.range(0, 5_000_000, 9_999).withColumn("g", F.when(F.col("id") % 3 == 0, "x").otherwise(F.col("id").cast("string")))
    rows = grouped_index(df, ["g"], "id", total="n").filter("g = 'x'").orderBy("id").collect()
    assert [r["pos"] for r in rows] == list(range(len(rows))) and {r["n"] for r in rows} == {len(rows)}


def test_average_ranks_match_sorting(spark):
    draw = random.Random(5)
    values = [draw.choice([0.0, -1.5, 2.25, 1e-9, -1e-9, 1e12, draw.random(), 0.5, 0.49999999999999994]) for _ in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "x double").groupBy("x").agg(F.count("*").alias("n"))
    got = {r["x"]: r["avg_rank"] for r in O.average_ranks(df, "x").collect()}
    ordered = sorted(values)
    for v in set(values):
        first, n = ordered.index(v) + 1, ordered.count(v)
        assert got[v] == first + (n - 1) / 2


@pytest.mark.parametrize("n, test, val", [(10, 0.1, 0.1), (101, 0.2, 0.1), (300, 0.2, 0.2), (1, 0.1, 0.1)])
def test_exact_split_sizes(spark, n, test, val):
    got = S.train_val_test_split(frame(spark, n), ["id"], test, val).groupBy("split").count().collect()
    sizes = {r["split"]: r["count"] for r in got}
    n_test = math.ceil(round(n * test, 9))
    n_val = math.ceil(round((n - n_test) * val, 9))
    assert (sizes.get("test", 0), sizes.get("validation", 0), sizes.get("train", 0)) == (n_test, n_val, n - n_test - n_val)


def test_splits_do_not_depend_on_partitions(spark):
    a = S.train_val_test_split(frame(spark, parts=1), ["id"]).select("id", "split")
    b = S.train_val_test_split(frame(spark, parts=8), ["id"]).select("id", "split")
    assert sorted(a.collect()) == sorted(b.collect())


def test_shuffle_order_equals_shuffled_index(spark):
    order = [r["id"] for r in S.seeded_shuffle(frame(spark), ["id"], 9).collect()]
    assert order == sorted(range(300), key=lambda i: (bits(9, i), i))


def test_caps_and_samples(spark):
    df = frame(spark).withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("label") + 1))
    counts = {r["split"]: r["count"] for r in S.cap_splits(df, {"train": 20, "validation": 10_000}, ["id"]).groupBy("split").count().collect()}
    assert counts == {"train": 20, "validation": df.filter("split = 'validation'").count()}
    assert S.sample_n(df, 17, ["id"]).count() == 17 and S.sample_n(df, 10_000, ["id"]).count() == 300


def test_oversampling_uses_integer_quotients(spark):
    df = spark.createDataFrame([(0,)] * 10 + [(1,)] * 3 + [(2,)] * 12, "label int")
    got = {r["label"]: r["count"] for r in S.oversample_classes(df).groupBy("label").count().collect()}
    assert got == {0: 10, 1: 9}


def test_weighted_sample_is_class_balanced(spark):
    df = spark.range(3000).withColumn("label", F.when(F.col("id") < 2500, 0).otherwise(1))
    rows = S.weighted_sample_replacement(df, "id").collect()
    assert len(rows) == 3000 and abs(sum(r["label"] for r in rows) / 3000 - 0.5) < 0.04
    assert all((r["id"] < 2500) == (r["label"] == 0) for r in rows)


def test_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "label int")
    got = {r["label"]: r["weight"] for r in S.balanced_class_weights(df).collect()}
    assert got == {0: 8 / (2 * 6), 1: 8 / (2 * 2)}
    assert {r["weight"] for r in S.inverse_frequency_weights(df).collect()} == {1 / 6, 1 / 2}


def test_batches_and_alternate_rows(spark):
    df = spark.createDataFrame([(i * 1000,) for i in range(11)], "id long")
    got = {r["id"]: r["batch"] for r in S.assign_batches(df, "id", 4).collect()}
    assert got == {i * 1000: i // 4 for i in range(11)}
    assert sorted(r["id"] for r in S.alternate_rows(df, "id").collect()) == [i * 1000 for i in range(0, 11, 2)]


def test_average_ranks_of_crowded_and_infinite_scores(spark):
    scores = [0.5 + i * 1e-9 for i in range(300)] + [float("inf"), float("-inf"), 0.0, -0.5, -0.5 - 1e-9]
    df = spark.createDataFrame([(s, 1) for s in scores], "score double, n long")
    got = {r["score"]: r["avg_rank"] for r in O.average_ranks(df, "score").collect()}
    assert got == {s: i + 1.0 for i, s in enumerate(sorted(scores))}


def test_inverse_weights_keep_the_null_class(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, None)], "id long, label string")
    assert {(r["id"], r["weight"]) for r in S.inverse_frequency_weights(df).collect()} == {(1, 1.0), (2, 0.5), (3, 0.5)}


def test_split_of_hashed_rows_equals_the_split_by_position(spark):
    """With nulls and rows that come twice; only the buckets in which a split ends are shuffled."""
    from phonolake.operators import positions as PO
    from phonolake.operators import sampling as SA

    for n, shares in ((1, (0.1, 0.1)), (0, (0.2, 0.1)), (700, (0.1, 0.1)), (700, (0.0, 0.5)), (700, (1.0, 0.3)), (9000, (0.2, 0.25))):
        rows = [(f"a{i % 650}" if i % 50 else None, f"b{i % 130}", i % 2) for i in range(n)]
        df = spark.createDataFrame(rows, "word1 string, word2 string, label int")
        ids = ["word1", "word2", "label"]
        want = SA.train_val_test_split(df, ids, *shares, seed=7)
        got = SA.train_val_test_split(PO.with_hash_bits(df, 7, ids), ids, *shares, seed=7, hashed=True)
        assert got.columns == want.columns and got.schema["split"].dataType == want.schema["split"].dataType
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
