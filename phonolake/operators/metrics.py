"""Scores over prediction tables. Every function takes ``by`` columns and gives one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.functions import phonetic as P
from phonolake.functions.scores import target_rank
from phonolake.functions.similarity import symbol_ratio
from phonolake.operators.positions import average_ranks


def _grouped(df: DataFrame, by: Sequence[str], *aggs) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def predictions_join(predictions: DataFrame, labels: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Predictions meet labels by row id, never by position."""
    return predictions.join(labels, on)


def accuracy(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    hit = (F.col(pred) == F.col(label)).cast("double")
    return _grouped(df, by, F.avg(hit).alias("accuracy"))


def _confusion(df, by, pred, label):
    p, t = F.col(pred) == 1, F.col(label) == 1
    return _grouped(
        df,
        by,
        F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"),
        F.count_if(~p & ~t).alias("tn"),
    )


def f1(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    """Binary F1 of class 1; 0 when nothing is predicted and nothing expected."""
    c = _confusion(df, by, pred, label)
    bottom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.select(*by, F.coalesce(F.try_divide(2 * F.col("tp"), bottom), F.lit(0.0)).alias("f1"))


def matthews(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    """Matthews correlation; 0 when a margin of the confusion table is empty."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    bottom = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    value = F.coalesce(F.try_divide(tp * tn - fp * fn, bottom), F.lit(0.0))
    return _confusion(df, by, pred, label).select(*by, value.alias("matthews"))


def pearson(df: DataFrame, by: Sequence[str] = (), left: str = "pred", right: str = "label") -> DataFrame:
    """NaN for a constant column, where the correlation is undefined."""
    x, y = F.col(left).cast("double"), F.col(right).cast("double")
    value = F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(float("nan")))
    return _grouped(df, by, value.alias("pearson"))


def spearman(df: DataFrame, by: Sequence[str] = (), left: str = "pred", right: str = "label") -> DataFrame:
    """Rank correlation with average ranks for ties; NaN for a constant column.

    Rows collapse to distinct (left, right) pairs before anything is ranked, so repeated scores
    cost one row, and ranks come from bucketed running totals instead of one global window.
    """
    by = list(by)
    cells = df.groupBy(*by, F.col(left).cast("double").alias("_x"), F.col(right).cast("double").alias("_y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return _rank_correlation(cells, by)


def _rank_correlation(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spearman correlation from the counts ``n`` of distinct (_x, _y)."""

    def ranks(column: str, out: str) -> DataFrame:
        sums = cells.groupBy(*by, column).agg(F.sum("n").alias("n"))
        return average_ranks(sums, column, by).select(*by, column, F.col("avg_rank").alias(out))

    ranked = cells.join(ranks("_x", "_rx"), [*by, "_x"]).join(ranks("_y", "_ry"), [*by, "_y"])
    totals = _grouped(
        ranked,
        by,
        F.sum("n").cast("double").alias("_n"),
        F.sum(F.col("n") * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("n") * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(F.col("n") * F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    # Average ranks always sum to n(n+1)/2, whatever the ties.
    square = F.col("_n") * F.pow((F.col("_n") + 1) / 2, F.lit(2.0))
    bottom = F.sqrt(F.col("_xx") - square) * F.sqrt(F.col("_yy") - square)
    value = F.coalesce(F.try_divide(F.col("_xy") - square, bottom), F.lit(float("nan")))
    return totals.select(*by, value.alias("spearman"))


def prediction_cells(df: DataFrame, by: Sequence[str], pred: str = "pred", label: str = "label", hit: str | None = None) -> DataFrame:
    """Counts ``n`` of each (label, pred) per group, with ``hits``, how many of them are marked in ``hit``.

    All metrics of class predictions follow from this table, so the rows are read once. Rows without a prediction
    or label are left out.
    """
    known = df.filter(F.col(pred).isNotNull() & F.col(label).isNotNull())
    hits = F.count_if(F.col(hit)) if hit else F.lit(0).cast("bigint")
    return known.groupBy(*by, label, pred).agg(F.count(F.lit(1)).alias("n"), hits.alias("hits"))


def cell_scores(cells: DataFrame, by: Sequence[str], pred: str = "pred", label: str = "label", hit_name: str | None = None) -> DataFrame:
    """``metric, value`` per group: accuracy, f1, matthews, macro, micro and, if named, the share of hits."""
    by = list(by)
    n, right, one = F.col("n"), F.col(pred) == F.col(label), F.col(pred) == 1
    per_label = cells.groupBy(*by, label).agg(
        F.sum("n").alias("n"), F.sum(F.when(right, n).otherwise(0)).alias("right"), F.sum(F.when(one, n).otherwise(0)).alias("ones"), F.sum("hits").alias("hits")
    )
    is_one = F.col(label) == 1
    part = lambda condition, value, name: F.sum(F.when(condition, value).otherwise(0)).cast("double").alias(name)
    sums = _grouped(
        per_label,
        by,
        F.sum("n").alias("n"),
        F.sum("right").alias("right"),
        F.sum("hits").alias("hits"),
        F.avg(F.col("right") / F.col("n")).alias("macro"),
        part(is_one, F.col("ones"), "tp"),
        part(~is_one, F.col("ones"), "fp"),
        part(is_one, F.col("n") - F.col("ones"), "fn"),
        part(~is_one, F.col("n") - F.col("ones"), "tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    or_zero = lambda top, bottom: F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    micro = F.col("right") / F.col("n")
    values = {
        "accuracy": micro,
        "f1": or_zero(2 * tp, 2 * tp + fp + fn),
        "matthews": or_zero(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)),
        "macro": F.col("macro"),
        "micro": micro,
    } | ({hit_name: F.col("hits") / F.col("n")} if hit_name else {})
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value")) for name, value in values.items()])
    return sums.select(*by, F.inline(rows))


def cell_spearman(cells: DataFrame, by: Sequence[str], pred: str = "pred", label: str = "label") -> DataFrame:
    """``metric, value`` per group: rank correlation of predictions and labels."""
    pairs = cells.groupBy(*by, F.col(pred).cast("double").alias("_x"), F.col(label).cast("double").alias("_y")).agg(F.sum("n").alias("n"))
    return _rank_correlation(pairs, list(by)).select(*by, F.lit("spearman").alias("metric"), F.col("spearman").alias("value"))


def roc_auc(df: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Area under the curve from the rank sum of the positives; null with a single class."""
    by = list(by)
    cells = df.groupBy(*by, F.col(score).cast("double").alias("_x")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) != 1).alias("_neg")
    )
    ranked = average_ranks(cells, "_x", by, weights=("_pos", "_neg"))
    sums = _grouped(
        ranked,
        by,
        F.sum(F.col("_pos") * F.col("avg_rank")).alias("_ranks"),
        F.sum("_pos").cast("double").alias("_p"),
        F.sum("_neg").cast("double").alias("_m"),
    )
    top = F.col("_ranks") - F.col("_p") * (F.col("_p") + 1) / 2
    return sums.select(*by, F.try_divide(top, F.col("_p") * F.col("_m")).alias("roc_auc"))


def macro_micro_accuracy(df: DataFrame, by: Sequence[str] = (), pred: str = "pred", label: str = "label") -> DataFrame:
    """Mean of per-class recall, and overall accuracy."""
    per_class = df.groupBy(*by, label).agg(
        F.count_if(F.col(pred) == F.col(label)).alias("_hits"), F.count(F.lit(1)).alias("_n")
    )
    return _grouped(
        per_class,
        by,
        F.avg(F.col("_hits") / F.col("_n")).alias("macro"),
        (F.sum("_hits") / F.sum("_n")).alias("micro"),
    )


def row_hits(
    df: DataFrame, k: int, keys: Sequence[str] = ("id",), logits: str = "logits", target: str = "target",
    single_target_top1: bool = False,
) -> DataFrame:
    """Per row: are all masked targets among the k best? ``target`` null marks a row without any.

    ``single_target_top1`` reproduces the historical check of rows with one masked target, which
    looked at the best token only.
    """
    ranked = df.withColumn("_rank", target_rank(F.col(logits), F.col(target)))
    limit = F.lit(k)
    if single_target_top1:
        limit = F.when(F.count(target) == 1, F.lit(1)).otherwise(F.lit(k))
    worst = F.coalesce(F.max(F.when(F.col(target).isNotNull(), F.col("_rank"))), F.lit(0))
    return ranked.groupBy(*keys).agg((worst <= limit).alias("hit"))


def hit_at_k(df: DataFrame, k: int, batch: str | None = None, id_col: str = "id", **options) -> DataFrame:
    """Share of rows hit at k; with ``batch`` the mean of the per-batch shares."""
    keyed = df.withColumn("_batch", F.col(batch) if batch else F.lit(0))
    hits = row_hits(keyed, k, [id_col, "_batch"], **options)
    rates = hits.groupBy("_batch").agg(F.avg(F.col("hit").cast("double")).alias("_rate"))
    return rates.agg(F.avg("_rate").alias("hit_at_k"))


def rhyme_score(df: DataFrame, left: str, right: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean similarity of the last (at most three) phonemes of two phoneme arrays."""
    a, b = F.col(left), F.col(right)
    tails = df.select(*by, P.rhyme_tail(a, b).alias("_a"), P.rhyme_tail(b, a).alias("_b"))
    return _grouped(tails, by, F.avg(symbol_ratio(F.col("_a"), F.col("_b"))).alias("rhyme_score"))


def iteration_summary(df: DataFrame, keys: Sequence[str] = ("model", "task", "metric"), value: str = "value") -> DataFrame:
    """Mean and population standard deviation over iterations."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def best_trial(trials: DataFrame, params: str = "params", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Parameters of the best trial; null and NaN values never win, of equal values the smallest parameters do."""
    valid = trials.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    best = F.min_by(F.struct(params, value), F.struct((-F.col(value)).alias("_rank"), params))
    return _grouped(valid, by, best.alias("_best")).select(*by, f"_best.{params}", f"_best.{value}")


def prediction_degeneracy(df: DataFrame, by: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    return _grouped(
        df, by, F.bool_and(F.col(pred) == 1).alias("all_one"), F.bool_or(F.col(pred) == 1).alias("any_one")
    )


def normalized_token_scores(df: DataFrame, id_col: str = "id", pos: str = "pos", scores: str = "scores") -> DataFrame:
    """Sum each token's vector, then divide by the L2 norm over the tokens of its row.

    The norm is an aggregate joined back, so rows of any length stay distributed.
    """
    token = df.withColumn(
        "score", F.aggregate(F.col(scores), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    ).drop(scores)
    norms = token.groupBy(id_col).agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("_norm"))
    return token.join(norms, id_col).withColumn("score", F.try_divide("score", "_norm")).drop("_norm")
