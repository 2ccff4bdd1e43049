"""Queries of thresholds, trials, splitters, channel selection and margin machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import ensemble as E
from sigmill.operators import metrics as M
from sigmill.operators import selection as C
from sigmill.operators import tables as B
from sigmill.operators import thresholds as T
from sigmill.plans.inputs import PREDICTIONS, RESULTS, SAMPLES, WINDOWS, predictions, results, samples, table, windows
from sigmill.plans.query import query


def _best_sql(metric: str) -> str:
    return f"""WITH {PREDICTIONS}, c AS (SELECT fold, score AS s, CAST(count(*) FILTER (truth = 1) AS DOUBLE) AS p, CAST(count(*) FILTER (truth = 0) AS DOUBLE) AS n FROM predictions GROUP BY fold, score),
    k AS (SELECT *, sum(p) OVER w AS fn, sum(n) OVER w AS tn, sum(p) OVER a - sum(p) OVER w AS tp, sum(n) OVER a - sum(n) OVER w AS fp FROM c WINDOW w AS (PARTITION BY fold ORDER BY s), a AS (PARTITION BY fold)),
    v AS (SELECT fold, s, {metric} AS value FROM k),
    l AS (SELECT *, lag(s) OVER w AS x1, lag(value) OVER w AS y1, lead(s) OVER w AS x3, lead(value) OVER w AS y3 FROM v WINDOW w AS (PARTITION BY fold ORDER BY s)),
    t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(value, 12) DESC, s) = 1),
    best AS (SELECT fold, value, CASE WHEN y1 IS NULL OR y3 IS NULL OR abs((s - x1) * (value - y3) - (s - x3) * (value - y1)) < 1e-300 THEN s ELSE s - (power(s - x1, 2) * (value - y3) - power(s - x3, 2) * (value - y1)) / (2 * ((s - x1) * (value - y3) - (s - x3) * (value - y1))) END AS threshold FROM t)"""


@query("threshold_optimization", _best_sql("(tp / (tp + fn) + tn / (tn + fp)) / 2") + " SELECT id, fold, round(score - threshold, 6) + 0.0 AS score, CAST(score > threshold AS BIGINT) AS predicted FROM predictions JOIN best USING (fold)")
def threshold_optimization(spark, d):
    p = predictions(spark, d)
    moved = T.shift_to_threshold(p, T.best_threshold(p, ["fold"], "truth", 1), ["fold"])
    return moved.select("id", "fold", r6("score").alias("score"), (F.col("score") > 0).cast("long").alias("predicted"))


@query("threshold_optimization_f", _best_sql("2 * tp / (2 * tp + fp + fn)") + " SELECT fold, round(threshold, 6) + 0.0 AS threshold, round(value, 6) AS value FROM best")
def threshold_optimization_f(spark, d):
    return T.best_threshold(predictions(spark, d), ["fold"], "truth", 1, metric="F_measure").select("fold", r6("threshold").alias("threshold"), r6("value").alias("value"))


@query("adaptive_threshold_classifier", f"WITH {WINDOWS}, o AS (SELECT user_id, win, marker, max(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS a FROM windows GROUP BY 1, 2, 3) SELECT user_id, win, CASE WHEN sum(a) >= 2 THEN 'movement' ELSE 'no_movement' END AS label, CAST(sum(a) >= 2 AS DOUBLE) AS prediction FROM o GROUP BY user_id, win")
def adaptive_threshold_classifier(spark, d):
    """Event types are the channels; a value above 60 is an onset."""
    w = windows(spark, d).withColumn("onset", (F.col("value") > 60).cast("int"))
    return T.onset_classifier(w, ["user_id", "win"], "marker", "onset", ("no_movement", "movement"), 2).select("user_id", "win", "label", "prediction")


@query("random_classifier", f"WITH {PREDICTIONS} SELECT id, CAST(((id * 2654435761) % 4294967296) // 2147483648 AS BIGINT) AS predicted FROM predictions")
def random_classifier(spark, d):
    """One of the two labels, each with the same chance; the id fixes which."""
    return E.random_labels(predictions(spark, d).select("id"), "id", [0, 1]).select("id", F.col("predicted").cast("long").alias("predicted"))


@query("all_train_split", f"WITH {PREDICTIONS} SELECT id, truth, 'train' AS part FROM predictions")
def all_train_split(spark, d):
    return predictions(spark, d).select("id", "truth", F.lit("train").alias("part"))


@query(
    "leave_one_out_metrics",
    f"""WITH {PREDICTIONS}, s AS (SELECT fold, sum(score) FILTER (truth = 1) AS sp, count(*) FILTER (truth = 1) AS cp, sum(score) FILTER (truth = 0) AS sn, count(*) FILTER (truth = 0) AS cn FROM predictions GROUP BY fold),
    m AS (SELECT p.fold, truth, score, CASE WHEN truth = 1 THEN (sp - score) / nullif(cp - 1, 0) ELSE sp / nullif(cp, 0) END AS p, CASE WHEN truth = 0 THEN (sn - score) / nullif(cn - 1, 0) ELSE sn / nullif(cn, 0) END AS n FROM predictions p JOIN s USING (fold)),
    q AS (SELECT fold, truth, CASE WHEN p IS NULL THEN 0 WHEN n IS NULL OR abs(score - p) <= abs(score - n) THEN 1 ELSE 0 END AS predicted FROM m)
    SELECT fold, count(*) FILTER (truth = 1 AND predicted = 1) AS "TP", count(*) FILTER (truth = 0 AND predicted = 1) AS "FP", count(*) FILTER (truth = 0 AND predicted = 0) AS "TN", count(*) FILTER (truth = 1 AND predicted = 0) AS "FN" FROM q GROUP BY fold""",
)
def leave_one_out_metrics(spark, d):
    p = T.mean_classifier_left_out(predictions(spark, d).drop("predicted"), ["fold"], "truth", 1)
    return M.confusion(p, ["fold"], "truth", "predicted", 1).select("fold", *(F.col(c).cast("long").alias(c) for c in ("TP", "FP", "TN", "FN")))


@query(
    "sliding_window_trials",
    f"""WITH {SAMPLES}, w AS (SELECT user_id, t, value, t * 50 + (t // 12) * 500 AS a, t * 50 + (t // 12) * 500 + 100 AS b FROM samples),
    g AS (SELECT *, sum(CASE WHEN a - prev <= 0 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a, b) AS trial FROM (SELECT *, lag(b) OVER (PARTITION BY user_id ORDER BY a, b) AS prev FROM w)),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, trial ORDER BY a, b) AS place FROM g)
    SELECT user_id, CAST(trial AS BIGINT) AS trial, place, CASE WHEN place < 7 THEN 'before' ELSE 'after' END AS truth, round(value, 6) AS value FROM n WHERE place - 7 < -1 OR place - 7 >= 1""",
)
def sliding_window_trials(spark, d):
    """Windows in line without a gap are a trial; truth changes at its seventh window, those next to the change are left out."""
    t = F.col("t")
    start = t * 50 + F.floor(t / 12) * 500
    w = samples(spark, d).select("user_id", "t", "value", start.alias("a"), (start + 100).alias("b"))
    n = T.relabel_by_change(T.trials(w, ["user_id"], "a", "b", 0, F.floor(F.col("a") / 204800)), ["user_id", "trial"], "place", 7, "before", "after", (-1, 1))
    return n.select("user_id", "trial", "place", "truth", r6("value").alias("value"))


@query("consume_training_data", "WITH r AS (SELECT doc_id AS id, CAST(quality AS BIGINT) AS label, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 2654435761) % 4294967296, doc_id) - 1 AS rank, count(*) OVER (PARTITION BY quality) AS size FROM labels) SELECT id, label, CASE WHEN rank < round(size * 0.4) THEN 'inner' ELSE 'later' END AS part FROM r")
def consume_training_data(spark, d):
    """A share of each class trains the wrapped operator, the rest goes on to those after it."""
    labels = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("label"))
    inner = C.percentage(labels, "label", "id", 40.0).select("id", F.lit("inner").alias("part"))
    return labels.join(inner, "id", "left").select("id", "label", F.coalesce("part", F.lit("later")).alias("part"))


@query(
    "random_feature_selection",
    "WITH f AS (SELECT unnest(range(64)) AS f), k AS (SELECT f FROM f ORDER BY (f * 2654435761) % 4294967296, f LIMIT 10) SELECT vec_id AS id, CAST(f AS INTEGER) AS f, CAST(embedding[f + 1] AS DOUBLE) AS x FROM embeddings, k",
)
def random_feature_selection(spark, d):
    """Ten of the 64 features, which a hash of their numbers picks."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return C.take_features(e, "embedding", C.random_features(64, 10))


# ---- performance tables ----


@query("transform_metrics", f"WITH {RESULTS} SELECT row, coalesce(try_cast(CASE WHEN row % 7 = 0 THEN '' ELSE CAST(CAST(metric AS DECIMAL(18, 2)) AS VARCHAR) END AS DOUBLE), 0) AS metric FROM results")
def transform_metrics(spark, d):
    """Metric cells as text become numbers, empty ones 0."""
    cell = F.when(F.col("row") % 7 == 0, "").otherwise(F.col("metric").cast("decimal(18,2)").cast("string"))
    return B.numeric(results(spark, d).select("row", cell.alias("metric")), ["metric"])


@query(
    "parse_cells",
    """WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(CAST(value AS DECIMAL(18, 3)) AS VARCHAR) WHEN 2 THEN event_type ELSE '' END AS cell FROM events)
    SELECT event_id, CASE WHEN regexp_full_match(cell, '[+-]?[0-9]+') THEN 'int' WHEN try_cast(cell AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'str' END AS kind, try_cast(cell AS DOUBLE) AS number FROM c""",
)
def parse_cells(spark, d):
    """The kind of each cell of a table of text: integer, float or text."""
    cell = F.when(F.col("event_id") % 4 == 0, F.col("user_id").cast("string")).when(F.col("event_id") % 4 == 1, F.col("value").cast("decimal(18,3)").cast("string")).when(F.col("event_id") % 4 == 2, F.col("event_type")).otherwise("")
    c = table(spark, d, "events").select("event_id", cell.alias("cell"))
    return B.parse_cells(c, "cell").drop("cell")


@query("indexed_data", f'WITH {RESULTS} SELECT __dataset, __method, __run, max(row) AS row, arg_max(metric, row) AS metric FROM results GROUP BY 1, 2, 3')
def indexed_data(spark, d):
    """One row for each setting, the last of several."""
    return B.indexed(results(spark, d), ["__dataset", "__method", "__run"], "row", ["metric"])


@query("performance_entry", f"WITH {RESULTS} SELECT __run, row, metric FROM results WHERE __dataset = 'BUILDING' AND __method = '1-URGENT'")
def performance_entry(spark, d):
    return B.entry(results(spark, d), __dataset="BUILDING", __method="1-URGENT").select("__run", "row", "metric")


@query("compressed_analysis", f"WITH {RESULTS} SELECT __dataset, __method, count(*) AS n, round(avg(metric), 4) AS metric_mean, round(stddev_pop(metric), 4) AS metric_std, round(avg(time), 4) + 0.0 AS time_mean, round(stddev_pop(time), 4) AS time_std FROM results GROUP BY 1, 2")
def compressed_analysis(spark, d):
    """One figure for each combination of parameters: mean and deviation of every metric."""
    out = B.compressed(results(spark, d), ["__dataset", "__method"], ["metric", "time"])
    return out.select("__dataset", "__method", "n", *((F.round(c, 4) + 0.0).alias(c) for c in ("metric_mean", "metric_std", "time_mean", "time_std")))


@query("projected_results", f"WITH {RESULTS} SELECT __method, __run, row, metric, time FROM results WHERE __dataset = 'BUILDING'")
def projected_results(spark, d):
    """Rows with one value of a parameter, without it."""
    return B.project(results(spark, d), "__dataset", ["BUILDING"]).select("__method", "__run", "row", "metric", "time")
