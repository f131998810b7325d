import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phonolake.functions import scores as SC
from phonolake.operators import metrics as M
from phonolake.plans import scoring as PS
from phonolake.sources import files as FI


def one(df):
    return df.collect()[0]


def preds(spark, pairs):
    return spark.createDataFrame(pairs, "pred int, label int")


def test_binary_metrics(spark):
    draw = random.Random(2)
    pairs = [(draw.randint(0, 1), draw.randint(0, 1)) for _ in range(200)]
    df = preds(spark, pairs)
    p, t = np.array(pairs).T
    tp, fp, fn, tn = ((p * t).sum(), (p * (1 - t)).sum(), ((1 - p) * t).sum(), ((1 - p) * (1 - t)).sum())
    assert one(M.accuracy(df))[0] == pytest.approx((p == t).mean())
    assert one(M.f1(df))[0] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    mcc = (tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    assert one(M.matthews(df))[0] == pytest.approx(mcc)


def test_constant_predictions(spark):
    df = preds(spark, [(1, 0), (1, 1)])
    assert one(M.matthews(df))[0] == 0.0 and math.isnan(one(M.spearman(df))[0]) and math.isnan(one(M.pearson(df))[0])
    assert one(M.f1(preds(spark, [(0, 0)])))[0] == 0.0
    flags = one(M.prediction_degeneracy(df))
    assert flags["all_one"] and flags["any_one"]


def test_rank_metrics_with_ties(spark):
    draw = random.Random(4)
    rows = [(draw.choice("ab"), draw.randint(0, 5) / 3, draw.randint(0, 6) - 3.5, draw.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, y double, label int")
    frame = pd.DataFrame(rows, columns=["g", "x", "y", "label"])
    rho = {r["g"]: r["spearman"] for r in M.spearman(df, ["g"], "x", "y").collect()}
    auc = {r["g"]: r["roc_auc"] for r in M.roc_auc(df, ["g"], "x").collect()}
    for g, part in frame.groupby("g"):
        assert rho[g] == pytest.approx(np.corrcoef(part["x"].rank(), part["y"].rank())[0, 1])
        pos, neg = part["x"][part["label"] == 1].to_numpy(), part["x"][part["label"] == 0].to_numpy()
        wins = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
        assert auc[g] == pytest.approx(wins)
    assert one(M.roc_auc(df.filter("label = 1"), (), "x"))[0] is None


def test_macro_and_micro(spark):
    row = one(M.macro_micro_accuracy(preds(spark, [(0, 0), (0, 0), (1, 0), (1, 1), (0, 2)])))
    assert row["macro"] == pytest.approx((2 / 3 + 1 + 0) / 3) and row["micro"] == pytest.approx(3 / 5)


def test_hit_at_k_modes(spark):
    up = [0.1, 0.2, 0.3]
    rows = [(1, 0, 2, up), (2, 0, 1, up), (3, 1, 2, up), (3, 1, 1, up), (4, 1, None, up), (5, 1, 0, up)]
    df = spark.createDataFrame(rows, "id long, batch int, target int, logits array<double>")
    assert one(M.hit_at_k(df, 2))[0] == pytest.approx(4 / 5)
    assert one(M.hit_at_k(df, 2, "batch"))[0] == pytest.approx((1 + 2 / 3) / 2)
    assert one(M.hit_at_k(df, 2, single_target_top1=True))[0] == pytest.approx(3 / 5)


def test_rhyme_score_is_asymmetric_difflib(spark):
    pairs = [("abcde", "xcde"), ("tide", "diet"), ("", ""), ("a", "ba"), ("abc", "")]
    df = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "a array<string>, b array<string>")
    def want(a, b):
        n = min(len(a), len(b), 3)
        return SequenceMatcher(None, list(a)[-n:] if n else [], list(b)[-n:] if n else []).ratio()
    assert one(M.rhyme_score(df, "a", "b"))[0] == pytest.approx(np.mean([want(a, b) for a, b in pairs]))


def test_summary_uses_population_deviation(spark):
    df = spark.createDataFrame([("m", "t", "accuracy", v) for v in (0.1, 0.4, 0.7)], "model string, task string, metric string, value double")
    row = one(M.iteration_summary(df))
    assert row["mean"] == pytest.approx(0.4) and row["std"] == pytest.approx(np.std([0.1, 0.4, 0.7]))


def test_best_trial_ignores_missing(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, None), (4, float("nan"))], "params int, value double")
    assert one(M.best_trial(df))["params"] == 2


def test_logit_expressions(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, -2.0],)], "l array<double>")
    row = one(df.select(SC.argmax_class(F.col("l")).alias("a"), SC.topk_positions(F.col("l"), 3).alias("k"), SC.softmax_probs(F.col("l")).alias("s")))
    assert row["a"] == 1 and row["k"] == [1, 2, 0]
    powers = np.exp(np.array([1.0, 3.0, 3.0, -2.0]) - 3)
    assert row["s"] == pytest.approx(powers / powers.sum())


def test_regression_print_matches_python(spark):
    draw = random.Random(8)
    values = [-1.0, 0.0, 7.0, 1.0005, 0.9075, 2.5, 0.0005, 0.0015, 0.0025, 0.0625, 4.9995, 5.0] + [draw.uniform(0, 5) for _ in range(200)]
    values += [draw.randint(0, 5000) / 1000 + 0.0005 for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r[0] for r in df.orderBy("i").select(SC.clamp_regression(F.col("v"))).collect()]
    assert got == [f"{max(min(v, 5), 0):.3f}" for v in values]


def test_submission_gaps(spark):
    df = spark.createDataFrame([(0, 1), (3, 0)], "idx long, pred int")
    assert sorted(map(tuple, FI.submission_table(df, "rte").collect())) == [(0, "not_entailment"), (3, "entailment")]
    empty = FI.submission_table(df, "cola", "empty").orderBy("index").collect()
    assert [tuple(r) for r in empty] == [(0, "1"), (1, ""), (2, ""), (3, "0")]
    scored = spark.createDataFrame([(0, -0.5), (1, 9.0)], "idx long, pred double")
    assert sorted(map(tuple, FI.submission_table(scored, "stsb").collect())) == [(0, "0.000"), (1, "5.000")]


def test_scatter_across_blocks(spark):
    df = spark.createDataFrame([(2, "a"), (70_000, "b"), (131_071, "c")], "index long, v string")
    out = FI.index_scatter(df)
    assert out.count() == 131_072 and out.filter("v is not null").count() == 3


def test_random_baseline_levels(spark):
    rows = [(t, i, float(i % 2)) for t in ("rte", "qqp", "stsb") for i in range(400)]
    got = {r["task"]: r["mean"] for r in PS.random_baseline(spark.createDataFrame(rows, "task string, idx long, label double")).collect()}
    assert abs(got["rte"] - 0.5) < 0.03 and abs(got["qqp"] - 0.5) < 0.05 and abs(got["stsb"]) < 0.05


def test_token_scores_have_unit_norm(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [4.0]), (2, 0, [0.0])], "id long, pos int, scores array<double>")
    got = {(r["id"], r["pos"]): r["score"] for r in M.normalized_token_scores(df).collect()}
    assert got[(1, 0)] == pytest.approx(3 / 5) and got[(1, 1)] == pytest.approx(4 / 5) and got[(2, 0)] is None


def test_one_pass_scores_keep_parts_apart(spark):
    """Against plain Python, one group at a time; the rows are read once."""
    draw = random.Random(12)
    rows = [(i, "m", "mnli" if i % 3 else "rte", i % 2, [draw.random() for _ in range(3)], "matched" if i % 3 == 1 else "mismatched" if i % 3 else None) for i in range(300)]
    labels = [(i, draw.choice([0, 1, 1, 2, None])) for i in range(300)]
    left = spark.createDataFrame(rows, "id long, model string, task string, iteration int, logits array<double>, subset string")
    out = PS.score_predictions(left, spark.createDataFrame(labels, "id long, label int"), k=2, subset="subset").collect()
    got = {(r.task, r.metric): (r["mean"], r["std"]) for r in out}
    assert {t for t, _ in got} == {"rte", "mnli-matched", "mnli-mismatched"}
    for task in ("rte", "mnli-matched", "mnli-mismatched"):
        runs = {"accuracy": [], "micro": [], "macro": [], "f1": [], "hit_at_2": []}
        for turn in (0, 1):
            own = [(r[4], dict(labels)[r[0]]) for r in rows if r[3] == turn and "-".join(filter(None, (r[2], r[5]))) == task and dict(labels)[r[0]] is not None]
            pred = [(x.index(max(x)), y, x) for x, y in own]
            runs["accuracy"].append(sum(p == y for p, y, _ in pred) / len(pred))
            runs["micro"].append(runs["accuracy"][-1])
            recalls = [sum(p == y for p, y, _ in pred if y == c) / sum(y == c for _, y, _ in pred) for c in {y for _, y, _ in pred}]
            runs["macro"].append(sum(recalls) / len(recalls))
            tp, ones, true = sum(p == y == 1 for p, y, _ in pred), sum(p == 1 for p, _, _ in pred), sum(y == 1 for _, y, _ in pred)
            runs["f1"].append(2 * tp / (ones + true))
            runs["hit_at_2"].append(sum(sorted(x, reverse=True).index(x[y]) < 2 for _, y, x in pred) / len(pred))
        for metric, values in runs.items():
            assert got[task, metric][0] == pytest.approx(sum(values) / 2), (task, metric)
