"""Prediction tables and metrics.

``embeddings`` stands in for model output: its values, folded into classes, are the logits of a model and
``label`` is the truth. ``labels`` gives binary truth and predictions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from phonolake.functions import scores as SC
from phonolake.functions.hashing import hash_below
from phonolake.operators import encoding as E
from phonolake.operators import metrics as M
from phonolake.plans import scoring as PS
from phonolake.registry import sql as Q
from phonolake.registry.base import big, query, r6, scratch, table
from phonolake.sources import files as FI
from phonolake.sources.catalog import METERS, TASK_LABELS

K = 10


def folded_sql(n: int) -> str:
    return "[" + ", ".join(f"list_max(embedding[{k + 1}:len(embedding):{n}])" for k in range(n)) + "]"


LOGITS_SQL = folded_sql(K)
ARGMAX_SQL = f"(list_position({LOGITS_SQL}, list_max({LOGITS_SQL})) - 1)"


def logits(n: int = K):
    """All values folded into n classes: class k has the largest of the values k, k + n, k + 2n, ..."""
    last = F.size("embedding") - 1
    own = [F.transform(F.sequence(F.lit(k), last, F.lit(n)), lambda i: F.element_at("embedding", i + 1)) for k in range(n)]
    return F.array(*[F.array_max(x) for x in own])


def guesses(spark, d):
    """Ten-class predictions next to the truth."""
    return table(spark, d, "embeddings").select(
        "vec_id", big("label").alias("label"), big(SC.argmax_class(logits())).alias("pred")
    )


def binary(spark, d):
    """Quality as truth, a hashed guess as prediction."""
    return table(spark, d, "labels").select(
        "doc_id", big("quality").alias("label"), hash_below(2, "guess", "doc_id").alias("pred"),
        (F.col("doc_id") % 3).alias("model"),
    )


BINARY_SQL = f"bin AS (SELECT doc_id, quality AS label, {Q.below('2', 'guess', 'doc_id')} AS pred, doc_id % 3 AS model FROM labels)"


@query("argmax_class", f"SELECT vec_id, {ARGMAX_SQL}::BIGINT AS pred FROM embeddings")
def argmax_class(spark, d):
    return guesses(spark, d).select("vec_id", "pred")


@query(
    "softmax_probs",
    f"""WITH e AS (SELECT vec_id, list_transform({LOGITS_SQL}, lambda x: exp((x - list_max({LOGITS_SQL}))::DOUBLE)) AS p FROM embeddings),
    u AS (SELECT vec_id, unnest(p) / list_sum(p) AS prob, generate_subscripts(p, 1) - 1 AS class FROM e)
    SELECT vec_id, class::BIGINT AS class, round(prob, 6) AS prob FROM u""",
)
def softmax_probs(spark, d):
    spread = table(spark, d, "embeddings").select("vec_id", F.posexplode(SC.softmax_probs(logits())).alias("class", "prob"))
    return spread.select("vec_id", big("class").alias("class"), r6("prob").alias("prob"))


@query(
    "topk_positions",
    """WITH u AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) AS place, id::BIGINT AS id FROM u
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, id) <= 5""",
)
def topk_positions(spark, d):
    top = table(spark, d, "embeddings").select("vec_id", F.posexplode(SC.topk_positions(F.col("embedding"), 5)).alias("p", "id"))
    return top.select("vec_id", big(F.col("p") + 1).alias("place"), big("id").alias("id"))


@query(
    "label_to_name",
    f"SELECT vec_id, [{', '.join(Q.quote(n) for n in METERS)}][label % {len(METERS)} + 1] AS name FROM embeddings",
)
def label_to_name(spark, d):
    return table(spark, d, "embeddings").select("vec_id", SC.label_to_name(F.col("label") % len(METERS), METERS).alias("name"))


@query(
    "clamp_regression",
    "SELECT event_id, format('{:.3f}', greatest(least(value / 20 - 1, 5.0), 0.0)) AS score FROM events",
)
def clamp_regression(spark, d):
    return table(spark, d, "events").select("event_id", SC.clamp_regression(F.col("value") / 20 - 1).alias("score"))


@query(
    "model_short_name",
    "SELECT page_id, string_split(regexp_replace(split_part(url, '?', 1) || '/checkpoint-' || page_id, '/checkpoint-.*', ''), '/')[-1] AS name FROM pages",
)
def model_short_name(spark, d):
    path = F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("/checkpoint-"), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", SC.model_short_name(path).alias("name"))


@query(
    "l2_normalize_scores",
    """WITH t AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s, label FROM embeddings),
    n AS (SELECT label, sqrt(sum(s * s)) AS norm FROM t GROUP BY label)
    SELECT vec_id, t.label::BIGINT AS label, round(s / norm, 6) AS score FROM t JOIN n ON t.label = n.label""",
)
def l2_normalize_scores(spark, d):
    tokens = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("id"), F.col("embedding").alias("scores"))
    out = M.normalized_token_scores(tokens, "id", "vec_id")
    return out.select("vec_id", big("id").alias("label"), r6("score").alias("score"))


@query("filter_class_correct", f"SELECT vec_id, label::BIGINT AS label FROM embeddings WHERE {ARGMAX_SQL} = label")
def filter_class_correct(spark, d):
    return guesses(spark, d).filter("pred = label").select("vec_id", "label")


@query("predictions_join", f"WITH {BINARY_SQL} SELECT doc_id, pred, lang FROM bin JOIN documents USING (doc_id)")
def predictions_join(spark, d):
    predictions = binary(spark, d).select("doc_id", "pred")
    return M.predictions_join(predictions, table(spark, d, "documents").select("doc_id", "lang"), "doc_id")


@query(
    "index_scatter",
    f"WITH {BINARY_SQL} SELECT i::BIGINT AS index, pred FROM range((SELECT max(doc_id) + 1 FROM bin)) r(i) LEFT JOIN bin ON bin.doc_id = i",
)
def index_scatter(spark, d):
    return FI.index_scatter(binary(spark, d).select(F.col("doc_id").alias("index"), "pred"))


@query(
    "glue_submission",
    f"""WITH {BINARY_SQL} SELECT 'rte' AS task, doc_id AS index, CASE WHEN pred = 0 THEN 'entailment' ELSE 'not_entailment' END AS prediction FROM bin
    UNION ALL SELECT 'cola', i, coalesce(pred::VARCHAR, '') FROM range((SELECT max(doc_id) + 1 FROM bin)) r(i) LEFT JOIN bin ON bin.doc_id = i""",
)
def glue_submission(spark, d):
    """A file with named classes and skipped gaps, and one with numbers and empty gaps."""
    predictions = binary(spark, d).select(F.col("doc_id").alias("idx"), "pred")
    out = None
    for task, missing in (("rte", "skip"), ("cola", "empty")):
        path = FI.write_submission(FI.submission_table(predictions, task, missing), scratch(spark, f"submission-{task}"))
        rows = spark.read.option("header", True).option("sep", "\t").option("nullValue", "none").option("emptyValue", "").schema(
            "index bigint, prediction string"
        ).csv(path)
        rows = rows.select(F.lit(task).alias("task"), "index", F.coalesce("prediction", F.lit("")).alias("prediction"))
        out = rows if out is None else out.unionByName(rows)
    return out


# --- metrics ---------------------------------------------------------------------------------

@query("metric_accuracy", f"WITH {BINARY_SQL} SELECT model, round(avg((pred = label)::INT), 6) AS accuracy FROM bin GROUP BY model")
def metric_accuracy(spark, d):
    return M.accuracy(binary(spark, d), ["model"]).select("model", r6("accuracy").alias("accuracy"))


CONF_SQL = """conf AS (SELECT model, count(*) FILTER (pred = 1 AND label = 1)::DOUBLE AS tp, count(*) FILTER (pred = 1 AND label = 0)::DOUBLE AS fp,
  count(*) FILTER (pred = 0 AND label = 1)::DOUBLE AS fn, count(*) FILTER (pred = 0 AND label = 0)::DOUBLE AS tn FROM bin GROUP BY model)"""


@query("metric_f1", f"WITH {BINARY_SQL}, {CONF_SQL} SELECT model, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM conf")
def metric_f1(spark, d):
    return M.f1(binary(spark, d), ["model"]).select("model", r6("f1").alias("f1"))


@query(
    "metric_matthews",
    f"WITH {BINARY_SQL}, {CONF_SQL} SELECT model, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS matthews FROM conf",
)
def metric_matthews(spark, d):
    return M.matthews(binary(spark, d), ["model"]).select("model", r6("matthews").alias("matthews"))


RANK_SQL = """r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS ry FROM lineitem)"""


@query("metric_spearman", f"WITH {RANK_SQL} SELECT l_returnflag, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY l_returnflag")
def metric_spearman(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    out = M.spearman(rows, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", r6("spearman").alias("spearman"))


@query("metric_pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY l_returnflag")
def metric_pearson(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    out = M.pearson(rows, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return out.select("l_returnflag", r6("pearson").alias("pearson"))


@query(
    "metric_roc_auc",
    """WITH s AS (SELECT l_linestatus, (l_returnflag = 'R')::INT AS label, round(exp(l_discount) / (exp(l_discount) + exp(l_tax)), 9) AS x FROM lineitem),
    r AS (SELECT l_linestatus, label, rank() OVER (PARTITION BY l_linestatus ORDER BY x) + (count(*) OVER (PARTITION BY l_linestatus, x) - 1) / 2.0::DOUBLE AS rk FROM s),
    a AS (SELECT l_linestatus, sum(rk) FILTER (label = 1) AS ranks, count(*) FILTER (label = 1)::DOUBLE AS p, count(*) FILTER (label = 0)::DOUBLE AS m FROM r GROUP BY 1)
    SELECT l_linestatus, round((ranks - p * (p + 1) / 2) / (p * m), 5) AS roc_auc FROM a""",
)
def metric_roc_auc(spark, d):
    """AUC of the softmax probability of class 1, returned items as the positive class."""
    pair = F.array("l_tax", "l_discount")
    rows = table(spark, d, "lineitem").select(
        "l_linestatus", F.round(F.element_at(SC.softmax_probs(pair), 2), 9).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label")
    )
    return M.roc_auc(rows, ["l_linestatus"]).select("l_linestatus", F.round("roc_auc", 5).alias("roc_auc"))


@query(
    "metric_macro_micro_accuracy",
    f"""WITH g AS (SELECT label, {ARGMAX_SQL} AS pred FROM embeddings), c AS (SELECT label, avg((pred = label)::INT) AS recall FROM g GROUP BY label)
    SELECT round((SELECT avg(recall) FROM c), 6) AS macro, round((SELECT avg((pred = label)::INT) FROM g), 6) AS micro""",
)
def metric_macro_micro_accuracy(spark, d):
    return M.macro_micro_accuracy(guesses(spark, d)).select(r6("macro").alias("macro"), r6("micro").alias("micro"))


@query(
    "metric_hit_at_k",
    """WITH u AS (SELECT vec_id // 2 AS id, vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS tok FROM embeddings),
    o AS (SELECT id, vec_id, label, tok, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, tok) AS rk FROM u),
    h AS (SELECT id, bool_and(rk <= 20) AS hit FROM o WHERE tok = label GROUP BY id),
    b AS (SELECT avg(hit::INT) AS rate FROM h GROUP BY id // 32) SELECT round(avg(rate), 6) AS hit_at_k FROM b""",
)
def metric_hit_at_k(spark, d):
    """Two masked positions per row; batches of 32 rows."""
    rows = table(spark, d, "embeddings").select(
        F.expr("vec_id div 2").alias("id"), big("label").alias("target"), F.col("embedding").alias("logits"), F.expr("vec_id div 64").alias("batch")
    )
    return M.hit_at_k(rows, 20, "batch").select(r6("hit_at_k").alias("hit_at_k"))


@query("prediction_degeneracy", f"WITH {BINARY_SQL} SELECT model, bool_and(pred = 1)::BIGINT AS all_one, bool_or(pred = 1)::BIGINT AS any_one FROM bin GROUP BY model")
def prediction_degeneracy(spark, d):
    out = M.prediction_degeneracy(binary(spark, d), ["model"])
    return out.select("model", big(F.col("all_one").cast("int")).alias("all_one"), big(F.col("any_one").cast("int")).alias("any_one"))


RUNS_SQL = f"""runs AS (SELECT 'm' || (doc_id % 2) AS model, 'quality' AS task, i AS iteration, avg(({Q.below('2', 'run', 'i', 'doc_id')} = quality)::INT) AS value
  FROM labels, range(1, 6) r(i) GROUP BY ALL)"""


def runs(spark, d):
    """Accuracy of five hashed runs of two models."""
    rows = table(spark, d, "labels").withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(5))))
    rows = rows.select(
        F.concat(F.lit("m"), F.col("doc_id") % 2).alias("model"), F.lit("quality").alias("task"), "iteration",
        (hash_below(2, "run", F.col("iteration"), F.col("doc_id")) == F.col("quality")).cast("double").alias("hit"),
    )
    return rows.groupBy("model", "task", "iteration").agg(F.avg("hit").alias("value")).withColumn("metric", F.lit("accuracy"))


@query("iteration_summary", f"WITH {RUNS_SQL} SELECT model, task, 'accuracy' AS metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM runs GROUP BY ALL")
def iteration_summary(spark, d):
    out = M.iteration_summary(runs(spark, d))
    return out.select("model", "task", "metric", r6("mean").alias("mean"), r6("std").alias("std"))


@query(
    "write_metric_log",
    f"""WITH {RUNS_SQL}, s AS (SELECT model, task, avg(value) AS mean FROM runs GROUP BY ALL)
    SELECT model, task, 'accuracy' AS metric, 2::BIGINT AS lines, round(mean, 6) AS mean FROM s""",
)
def write_metric_log(spark, d):
    """Two runs of the same summary, the second one again, read back."""
    path = scratch(spark, "metric-log")
    summary = M.iteration_summary(runs(spark, d))
    for run in ("a", "b", "b"):
        FI.write_metric_log(summary, path, run_id=run)
    cells = F.split("value", "\t")
    lines = FI.read_appended(spark, path).select(*[cells[i].alias(c) for i, c in enumerate(("model", "task", "metric", "values"))])
    mean = F.regexp_extract("values", r"'mean': ([-0-9.E]+)", 1).cast("double")
    return lines.groupBy("model", "task", "metric").agg(F.count(F.lit(1)).alias("lines"), r6(F.avg(mean)).alias("mean"))


TASK_ROWS_SQL = f"""tasks AS (SELECT ['rte', 'sst2', 'qqp', 'mnli', 'qnli', 'cola', 'mrpc', 'stsb', 'wnli'][1 + doc_id % 9] AS task, doc_id AS idx, quality, toxic FROM labels),
 base AS (SELECT task, idx, i AS iteration, quality AS label,
   CASE WHEN task = 'stsb' THEN {Q.H(42, 'i', 'task', 'idx')} * 5 ELSE floor({Q.H(42, 'i', 'task', 'idx')} * CASE WHEN task = 'mnli' THEN 3 ELSE 2 END) END AS pred FROM tasks, range(1, 11) r(i)),
 acc AS (SELECT task, iteration, 'accuracy' AS metric, avg((pred = label)::INT)::DOUBLE AS value FROM base WHERE task NOT IN ('qqp', 'mrpc', 'stsb') GROUP BY ALL),
 f1v AS (SELECT task, iteration, 'f1' AS metric, coalesce(2.0::DOUBLE * count(*) FILTER (pred = 1 AND label = 1) / nullif(2 * count(*) FILTER (pred = 1 AND label = 1)
   + count(*) FILTER (pred = 1 AND label <> 1) + count(*) FILTER (pred <> 1 AND label = 1), 0), 0) AS value FROM base WHERE task IN ('qqp', 'mrpc') GROUP BY ALL),
 sr AS (SELECT task, iteration, rank() OVER (PARTITION BY task, iteration ORDER BY pred) + (count(*) OVER (PARTITION BY task, iteration, pred) - 1) / 2.0::DOUBLE AS rx,
   rank() OVER (PARTITION BY task, iteration ORDER BY label) + (count(*) OVER (PARTITION BY task, iteration, label) - 1) / 2.0::DOUBLE AS ry FROM base WHERE task = 'stsb'),
 sp AS (SELECT task, iteration, 'spearman' AS metric, corr(rx, ry) AS value FROM sr GROUP BY ALL)"""


@query(
    "random_baseline",
    f"WITH {TASK_ROWS_SQL} SELECT task, metric, round(avg(value), 6) AS mean FROM (SELECT * FROM acc UNION ALL SELECT * FROM f1v UNION ALL SELECT * FROM sp) GROUP BY ALL",
)
def random_baseline(spark, d):
    names = F.array(*[F.lit(t) for t in list(TASK_LABELS)[:9]])
    rows = table(spark, d, "labels").select(
        F.element_at(names, (F.col("doc_id") % 9 + 1).cast("int")).alias("task"), F.col("doc_id").alias("idx"), F.col("quality").alias("label")
    )
    return PS.random_baseline(rows).select("task", "metric", r6("mean").alias("mean"))


@query(
    "best_trial",
    """WITH t AS (SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY ALL)
    SELECT event_type, user_id AS params, round(value, 6) AS value FROM t QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id) = 1""",
)
def best_trial(spark, d):
    trials = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    out = M.best_trial(trials.withColumnRenamed("user_id", "params"), by=["event_type"])
    return out.select("event_type", "params", r6("value").alias("value"))


SCORER = [round(((i * 7) % 11 - 5) / 10, 1) for i in range(K)]


@query(
    "batch_score",
    f"SELECT vec_id, round(0.5::DOUBLE + {' + '.join(f'{LOGITS_SQL}[{i + 1}]::DOUBLE * {w}::DOUBLE' for i, w in enumerate(SCORER))}, 6) AS logit FROM embeddings",
)
def batch_score(spark, d):
    """A linear scorer as the caller's model, applied in bounded batches."""

    def predict(frame):
        features = np.stack(frame["features"].to_numpy()).astype("float64")
        return frame[["vec_id"]].assign(logit=features @ np.array(SCORER) + 0.5)

    rows = table(spark, d, "embeddings").select("vec_id", logits().alias("features"))
    out = E.batch_score(rows, predict, ["vec_id", "features"], "vec_id bigint, logit double")
    return out.select("vec_id", r6("logit").alias("logit"))


@query(
    "linear_score",
    f"SELECT vec_id, round(0.5::DOUBLE + {' + '.join(f'{LOGITS_SQL}[{i + 1}]::DOUBLE * {w}::DOUBLE' for i, w in enumerate(SCORER))}, 6) AS logit FROM embeddings",
)
def linear_score(spark, d):
    """The same scorer as a native expression."""
    return table(spark, d, "embeddings").select("vec_id", r6(SC.linear_score(logits(), SCORER, 0.5)).alias("logit"))


@query(
    "score_predictions",
    f"""WITH p AS (SELECT 'm' || (vec_id % 2) AS model, CASE vec_id % 3 WHEN 0 THEN 'verses' WHEN 1 THEN 'mnli-matched' ELSE 'mnli-mismatched' END AS task,
      vec_id % 5 AS iteration, label % 3 AS label, {folded_sql(3)} AS logits FROM embeddings),
    s AS (SELECT model, task, iteration, label, list_position(logits, list_max(logits)) - 1 AS pred,
      len(list_filter(logits, lambda x: x > logits[label + 1])) < 2 AS hit FROM p),
    k AS (SELECT model, task, iteration, label, avg((pred = label)::INT) AS recall FROM s GROUP BY ALL),
    m AS (SELECT model, task, iteration, avg(recall) AS macro FROM k GROUP BY ALL),
    g AS (SELECT model, task, iteration, avg((pred = label)::INT) AS accuracy, avg(hit::INT) AS hits, count(*) FILTER (pred = 1 AND label = 1)::DOUBLE AS tp,
      count(*) FILTER (pred = 1 AND label <> 1)::DOUBLE AS fp, count(*) FILTER (pred <> 1 AND label = 1)::DOUBLE AS fn, count(*) FILTER (pred <> 1 AND label <> 1)::DOUBLE AS tn FROM s GROUP BY ALL),
    r AS (SELECT model, task, iteration, rank() OVER (PARTITION BY model, task, iteration ORDER BY pred) + (count(*) OVER (PARTITION BY model, task, iteration, pred) - 1) / 2.0::DOUBLE AS rx,
      rank() OVER (PARTITION BY model, task, iteration ORDER BY label) + (count(*) OVER (PARTITION BY model, task, iteration, label) - 1) / 2.0::DOUBLE AS ry FROM s),
    v AS (SELECT model, task, 'accuracy' AS metric, accuracy::DOUBLE AS value FROM g UNION ALL SELECT model, task, 'micro', accuracy FROM g
      UNION ALL SELECT model, task, 'hit_at_2', hits FROM g
      UNION ALL SELECT model, task, 'f1', coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) FROM g
      UNION ALL SELECT model, task, 'matthews', coalesce((tp * tn - fp * fn) / nullif(sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn), 0), 0) FROM g
      UNION ALL SELECT model, task, 'macro', macro FROM m
      UNION ALL SELECT model, task, 'spearman', c FROM (SELECT model, task, iteration, corr(rx, ry) AS c FROM r GROUP BY ALL))
    SELECT model, task, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM v GROUP BY ALL""",
)
def score_predictions(spark, d):
    """All metrics of three tasks, two of them the parts of one, from one pass over the rows."""
    rows = table(spark, d, "embeddings")
    part = F.col("vec_id") % 3
    predictions = rows.select(
        F.col("vec_id").alias("id"), F.concat(F.lit("m"), F.col("vec_id") % 2).alias("model"), F.when(part == 0, "verses").otherwise("mnli").alias("task"),
        F.when(part == 1, "matched").when(part == 2, "mismatched").alias("subset"), (F.col("vec_id") % 5).alias("iteration"), logits(3).alias("logits"),
    )
    labels = rows.select(F.col("vec_id").alias("id"), (F.col("label") % 3).alias("label"))
    out = PS.score_predictions(predictions, labels, k=2, subset="subset")
    return out.select("model", "task", "metric", r6("mean").alias("mean"), r6("std").alias("std"))
