"""From predictions to the result log."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.functions.hashing import hash_unit
from phonolake.functions.scores import argmax_class, softmax_probs, target_rank
from phonolake.operators import metrics as M
from phonolake.session import ensure_checkpoint_dir
from phonolake.sources.catalog import TASK_LABELS, TASK_METRIC

KEYS = ("model", "task", "iteration")


def score_cells(joined: DataFrame, by: Sequence[str] = KEYS, k: int | None = None) -> DataFrame:
    """Counts of (label, prediction) per group in a single pass; with ``k`` also how many labels are among the k best classes.

    The table has at most classes x classes rows per group and is written to the checkpoint folder.
    """
    ensure_checkpoint_dir(joined.sparkSession)
    scored = joined.withColumn("pred", argmax_class(F.col("logits")))
    if k:
        scored = scored.withColumn("hit", target_rank(F.col("logits"), F.col("label")) <= k)
    return M.prediction_cells(scored, by, hit="hit" if k else None).checkpoint()


def classification_values(joined: DataFrame, by: Sequence[str] = KEYS, with_auc: bool = False, k: int | None = None) -> DataFrame:
    """Long table of accuracy, F1, Matthews, macro and micro accuracy, Spearman and hit@k per group.

    All but the area under the curve come from one table of counts; that one needs the scores themselves.
    """
    cells = score_cells(joined, by, k)
    out = M.cell_scores(cells, by, hit_name=f"hit_at_{k}" if k else None).unionByName(M.cell_spearman(cells, by))
    if with_auc:
        ranked = joined.withColumn("score", F.element_at(softmax_probs(F.col("logits")), 2))
        auc = M.roc_auc(ranked, by)
        out = out.unionByName(auc.select(*by, F.lit("roc_auc").alias("metric"), F.col("roc_auc").cast("double").alias("value")))
    return out


def score_predictions(
    predictions: DataFrame, labels: DataFrame, on: str = "id", with_auc: bool = False, k: int | None = None, subset: str | None = None
) -> DataFrame:
    """``model, task, metric, mean, std`` over iterations.

    ``subset`` names a column that keeps parts of a task apart, as the matched and mismatched rows of mnli:
    the task becomes ``task-subset`` where it is not null.
    """
    joined = M.predictions_join(predictions, labels, on)
    if subset:
        joined = joined.withColumn("task", F.concat_ws("-", "task", subset))
    return M.iteration_summary(classification_values(joined, with_auc=with_auc, k=k))


def random_baseline(labels: DataFrame, iterations: int = 10, seed: int | str = 42) -> DataFrame:
    """Mean metric per task of uniform predictions; ``labels`` has task, idx, label.

    Every row carries its iterations with it, so the table is read once; the counts of (label, prediction) are
    written before anything is ranked.
    """
    ensure_checkpoint_dir(labels.sparkSession)
    sizes = F.create_map(*chain.from_iterable((F.lit(t), F.lit(n)) for t, n in TASK_LABELS.items()))
    metric = F.create_map(*chain.from_iterable((F.lit(t), F.lit(TASK_METRIC.get(t, "accuracy"))) for t in TASK_LABELS))
    runs = labels.select("task", "idx", "label", F.explode(F.sequence(F.lit(1), F.lit(iterations))).alias("iteration"))
    runs = runs.withColumn("_k", F.try_element_at(sizes, F.col("task")))
    # one hash a row: the class is the number scaled down, the score of a regression the number scaled up
    unit = hash_unit(seed, F.col("iteration"), F.col("task"), F.col("idx"))
    guess = F.when(F.col("_k") == 1, F.col("_u") * 5).otherwise(F.floor(F.col("_u") * F.col("_k")).cast("double"))
    by = ("task", "iteration")
    cells = M.prediction_cells(runs.withColumn("_u", unit).withColumn("pred", guess), by).checkpoint()
    ranked = M.cell_spearman(cells.filter(F.try_element_at(metric, F.col("task")) == "spearmanr"), by)
    values = M.cell_scores(cells, by).filter(F.col("metric") == F.try_element_at(metric, F.col("task"))).unionByName(ranked)
    return values.groupBy("task", "metric").agg(F.avg("value").alias("mean"))
