"""Queries of metrics, features and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import features as X
from sigmill.operators import metrics as M
from sigmill.operators import normalize as N
from sigmill.plans.inputs import CHANNEL_SQL, CHANNELS, FEATURES, PREDICTIONS, RECORDS, WINDOWS, channels, features, predictions, records, table, windows
from sigmill.plans.query import query

_COUNTS = """counts AS (SELECT fold, count(*) FILTER (truth = 1 AND predicted = 1) AS TP, count(*) FILTER (truth = 0 AND predicted = 0) AS TN,
  count(*) FILTER (truth = 0 AND predicted = 1) AS FP, count(*) FILTER (truth = 1 AND predicted = 0) AS FN FROM predictions GROUP BY fold)"""


def _counts(spark, d):
    return M.confusion(predictions(spark, d), ["fold"], "truth", "predicted", 1)


def _round(df, keys, digits=6):
    return df.select(*keys, *((F.round(c, digits) + F.lit(0.0)).alias(c) for c in df.columns if c not in keys))


_METRICS = {
    "True_positive_rate": "CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fn) END", "True_negative_rate": "CASE WHEN tn = 0 THEN 0 ELSE tn / (tn + fp) END",
    "False_positive_rate": "1 - CASE WHEN tn = 0 THEN 0 ELSE tn / (tn + fp) END", "False_negative_rate": "1 - CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fn) END",
    "IR_precision": "CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fp) END", "Non_IR_precision": "CASE WHEN tn = 0 THEN 0 ELSE tn / (tn + fn) END",
    "F_measure": "CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END", "Non_IR_F_measure": "CASE WHEN tn = 0 THEN 0 ELSE 2 * tn / (2 * tn + fp + fn) END",
    "Percent_correct": "100 * (tp + tn) / (tp + tn + fp + fn)", "Percent_incorrect": "100 * (fp + fn) / (tp + tn + fp + fn)",
    "Balanced_accuracy": "(tp / (tp + fn) + tn / (tn + fp)) / 2", "Weighted_accuracy": "0.7 * tp / (tp + fn) + 0.3 * tn / (tn + fp)",
    "ROC_measure": "sqrt((power(tp / (tp + fn), 2) + power(tn / (tn + fp), 2)) / 2)", "Gmean": "sqrt(tp / (tp + fn) * tn / (tn + fp))",
    "Matthews": "CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <= 0 THEN 0 ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END",
    "Kappa": "(tp + tn - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (tp + tn + fp + fn)) / ((tp + tn + fp + fn) - ((tp + fn) * (tp + fp) + (tn + fp) * (tn + fn)) / (tp + tn + fp + fn))",
}
_METRIC_SQL = ", ".join(f'round(CAST({v} AS DOUBLE), 6) + 0.0 AS "{k}"' for k, v in _METRICS.items())
_DOUBLES = "SELECT {keys} CAST({f}TP{g} AS DOUBLE) AS tp, CAST({f}TN{g} AS DOUBLE) AS tn, CAST({f}FP{g} AS DOUBLE) AS fp, CAST({f}FN{g} AS DOUBLE) AS fn FROM counts"


@query("confusion_metrics", f"WITH {PREDICTIONS}, {_COUNTS}, c AS ({_DOUBLES.format(keys='fold,', f='', g='')}) SELECT fold, {_METRIC_SQL} FROM c")
def confusion_metrics(spark, d):
    return _round(M.from_counts(_counts(spark, d)).drop("TP", "TN", "FP", "FN"), ["fold"])


@query("confusion_counts", f"WITH {PREDICTIONS}, {_COUNTS} SELECT * FROM counts")
def confusion_counts(spark, d):
    return _counts(spark, d)


@query("merge_splits", f"WITH {PREDICTIONS}, {_COUNTS}, c AS ({_DOUBLES.format(keys='fold % 2 AS half,', f='sum(', g=')')} GROUP BY half) SELECT half, {_METRIC_SQL} FROM c")
def merge_splits(spark, d):
    return _round(M.merge_splits(_counts(spark, d).withColumn("half", F.col("fold") % 2), ["half"]).drop("TP", "TN", "FP", "FN"), ["half"])


def _soft_sql(weight: str) -> str:
    cell = lambda c, n: f"round(sum(CASE WHEN {c} THEN w ELSE 0.0 END), 6) + 0.0 AS {n}"
    return f"WITH {PREDICTIONS}, x AS (SELECT *, least(abs(score), 1.0) AS s FROM predictions), y AS (SELECT *, {weight} AS w FROM x) SELECT fold, {cell('truth = 1 AND score > 0', 'TP')}, {cell('truth <> 1 AND NOT score > 0', 'TN')}, {cell('truth <> 1 AND score > 0', 'FP')}, {cell('truth = 1 AND NOT score > 0', 'FN')} FROM y GROUP BY fold"


@query("soft_confusion", _soft_sql("s"))
def soft_confusion(spark, d):
    return _round(M.soft_confusion(predictions(spark, d), ["fold"], "truth", "score", 1), ["fold"])


@query("polynomial_confusion", _soft_sql("s * s * (3 - 2 * s)"))
def polynomial_confusion(spark, d):
    return _round(M.soft_confusion(predictions(spark, d), ["fold"], "truth", "score", 1, "pol"), ["fold"])


@query(
    "auc",
    f"""WITH {PREDICTIONS}, x AS (SELECT fold, truth, round(score, 3) AS s FROM predictions)
    SELECT p.fold, round(avg(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0.0 END), 6) + 0.0 AS "AUC" FROM x p JOIN x n ON p.fold = n.fold AND p.truth = 1 AND n.truth = 0 GROUP BY p.fold""",
)
def auc(spark, d):
    return _round(M.auc(predictions(spark, d), ["fold"], "truth", "score", 1), ["fold"])


@query(
    "roc_points",
    f"""WITH {PREDICTIONS}, t AS (SELECT fold, round(score, 3) AS threshold, sum(truth) AS p, sum(1 - truth) AS n FROM predictions GROUP BY 1, 2)
    SELECT fold, threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp FROM t WINDOW w AS (PARTITION BY fold ORDER BY threshold DESC)""",
)
def roc_points(spark, d):
    return M.roc_points(predictions(spark, d), ["fold"], "truth", "score", 1).select("fold", "threshold", "tp", "fp")


@query(
    "mutual_information",
    f"""WITH {PREDICTIONS}, j AS (SELECT fold, truth, predicted, CAST(count(*) AS DOUBLE) AS n FROM predictions GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY fold) AS total, sum(n) OVER (PARTITION BY fold, truth) AS a, sum(n) OVER (PARTITION BY fold, predicted) AS b FROM j),
    h AS (SELECT fold, -sum(a / total * log2(a / total)) AS entropy FROM (SELECT DISTINCT fold, truth, a, total FROM k) GROUP BY fold)
    SELECT fold, round(sum(n / total * log2(n * total / (a * b))), 6) + 0.0 AS "MI", round(sum(n / total * log2(n * total / (a * b))) / min(entropy), 6) + 0.0 AS "NMI" FROM k JOIN h USING (fold) GROUP BY fold""",
)
def mutual_information(spark, d):
    return _round(M.mutual_information(_counts(spark, d)).select("fold", "MI", "NMI"), ["fold"])


@query(
    "hinge_losses",
    f"""WITH {PREDICTIONS}, x AS (SELECT fold, truth, score, CASE WHEN truth = 1 THEN 1.0 ELSE -1.0 END AS y FROM predictions), l AS (SELECT *, greatest(1 - y * score, 0.0) AS h FROM x)
    SELECT fold, round(avg(h), 6) AS "L1", round(avg(h * h), 6) AS "L2", round(avg(least(h, 2.0)), 6) AS "L1_restricted", round(avg(abs(score - y)), 6) AS "plain_L1", round(avg(power(score - y, 2)), 6) AS "plain_L2",
      round((coalesce(avg(h) FILTER (truth = 1), 0) + coalesce(avg(h) FILTER (truth = 0), 0)) / 2, 6) AS "L1_balanced" FROM l GROUP BY fold""",
)
def hinge_losses(spark, d):
    return _round(M.losses(predictions(spark, d), ["fold"], "truth", "score", 1), ["fold"])


@query(
    "multiclass_metrics",
    """WITH x AS (SELECT l_linenumber % 2 AS half, l_returnflag AS t, CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p FROM lineitem), c AS (SELECT DISTINCT half, c FROM (SELECT half, t AS c FROM x UNION ALL SELECT half, p FROM x)),
    k AS (SELECT c.half, c.c, CAST(count(*) FILTER (x.t = c.c) AS DOUBLE) AS tr, CAST(count(*) FILTER (x.p = c.c) AS DOUBLE) AS pr, CAST(count(*) FILTER (x.t = c.c AND x.p = c.c) AS DOUBLE) AS hit FROM c JOIN x ON c.half = x.half GROUP BY c.half, c.c)
    SELECT CAST(half AS INTEGER) AS half, count(*) AS classes, round(sum(hit) / sum(tr), 6) AS "Accuracy", round(avg(CASE WHEN tr = 0 THEN 1 ELSE hit / tr END), 6) AS "Balanced_accuracy", round(avg(2 * hit / (tr + pr)), 6) AS "macro_F",
      round((sum(tr) * sum(hit) - sum(tr * pr)) / (sqrt(sum(tr) * sum(tr) - sum(tr * tr)) * sqrt(sum(tr) * sum(tr) - sum(pr * pr))), 6) + 0.0 AS "Matthews" FROM k GROUP BY half""",
)
def multiclass_metrics(spark, d):
    q = F.col("l_quantity")
    x = table(spark, d, "lineitem").select((F.col("l_linenumber") % 2).alias("half"), F.col("l_returnflag").alias("t0"), F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("p0"))
    return _round(M.multiclass(x, ["half"], "t0", "p0"), ["half", "classes"])


@query(
    "regression_metrics",
    """WITH x AS (SELECT l_returnflag AS flag, l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem), m AS (SELECT flag, avg(y) AS m FROM x GROUP BY flag)
    SELECT flag, round(avg(power(p - y, 2)), 2) AS "MSE", round(sqrt(avg(power(p - y, 2))), 4) AS "RMSE", round(avg(abs(p - y)), 4) AS "MAE", round(avg(power(p - y, 2)) / var_pop(y), 6) AS "RSE", round(avg(abs(p - y)) / avg(abs(y - m)), 6) AS "RAE", round(corr(y, p), 6) AS correlation FROM x JOIN m USING (flag) GROUP BY flag""",
)
def regression_metrics(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    m = M.regression(x, ["flag"], "y", "p")
    return m.select("flag", F.round("MSE", 2).alias("MSE"), F.round("RMSE", 4).alias("RMSE"), F.round("MAE", 4).alias("MAE"), F.round("RSE", 6).alias("RSE"), F.round("RAE", 6).alias("RAE"), F.round("correlation", 6).alias("correlation"))


@query("metric_average", f"WITH {PREDICTIONS}, {_COUNTS}, a AS (SELECT fold % 2 AS half, CAST(TP + TN AS DOUBLE) / (TP + TN + FP + FN) * 100 AS acc FROM counts) SELECT half, round(avg(acc), 6) AS \"Percent_correct_mean\", round(stddev_pop(acc), 6) + 0.0 AS \"Percent_correct_std\" FROM a GROUP BY half")
def metric_average(spark, d):
    return _round(M.average(M.from_counts(_counts(spark, d)).withColumn("half", F.col("fold") % 2), ["half"], ["Percent_correct"]), ["half"])


# ---- features ----


@query(
    "stat_features",
    f"""WITH {WINDOWS}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY user_id, win) AS c FROM windows)
    SELECT user_id, win, round(avg(value), 6) AS raw_1, round(sum(value * value), 4) AS raw_2, round(avg(value ** 3), 2) AS raw_3, round(avg(c * c), 2) + 0.0 AS central_2, round(avg(c ** 3), 2) + 0.0 AS central_3, round(stddev_pop(value), 6) + 0.0 AS std, round(sqrt(sum(value * value)), 6) AS quadratic_mean, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS min, max(value) AS max FROM c GROUP BY user_id, win""",
)
def stat_features(spark, d):
    s = X.statistics(windows(spark, d), ["user_id", "win"], "value", 3)
    digits = {"raw_1": 6, "raw_2": 4, "raw_3": 2, "central_2": 2, "central_3": 2, "std": 6, "quadratic_mean": 6, "median": 6}
    return s.select("user_id", "win", *((F.round(c, n) + F.lit(0.0)).alias(c) for c, n in digits.items()), "min", "max")


_PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]]


@query(
    "pearson_segments",
    f"WITH {RECORDS}, s AS (SELECT *, t // 3 AS segment FROM records), x AS ("
    + " UNION ALL ".join(f"SELECT win, segment, '{a}:{b}' AS pair, count(*) AS n, covar_pop({a}, {b}) AS c, stddev_pop({a}) * stddev_pop({b}) AS s FROM s GROUP BY win, segment" for a, b in _PAIRS)
    + ") SELECT win, CAST(segment AS BIGINT) AS segment, pair, n, round(c / s, 5) + 0.0 AS r FROM x WHERE n >= 3 AND s > 1e-6",
)
def pearson_segments(spark, d):
    out = X.pearson(records(spark, d), ["win"], "t", CHANNELS, 3).filter("n >= 3 AND r IS NOT NULL")
    return out.select("win", "segment", "pair", "n", (F.round("r", 5) + F.lit(0.0)).alias("r"))


@query(
    "class_average_correlation",
    f"""WITH {WINDOWS}, w AS (SELECT *, user_id % 2 AS label FROM windows), m AS (SELECT label AS class, k, avg(value) AS m FROM w WHERE win % 2 = 0 GROUP BY 1, 2)
    SELECT user_id, win, CAST(class AS BIGINT) AS class, count(*) AS n, round(corr(value, m), 5) + 0.0 AS r FROM w JOIN m USING (k) GROUP BY user_id, win, class HAVING count(*) = 16""",
)
def class_average_correlation(spark, d):
    w = windows(spark, d).withColumns({"label": F.col("user_id") % 2, "channel": F.lit("value")})
    out = X.class_average_correlation(w, ["user_id", "win"], "k", "channel", "value", "label", F.col("win") % 2 == 0)
    return out.filter("n = 16").select("user_id", "win", F.col("class").cast("long").alias("class"), "n", (F.round("r", 5) + F.lit(0.0)).alias("r"))


@query(
    "straight_line",
    f"WITH {WINDOWS} SELECT user_id, win, CAST(k // 4 AS BIGINT) AS segment, count(*) AS n, round(regr_slope(value, k % 4), 5) + 0.0 AS slope, round(regr_intercept(value, k % 4), 5) + 0.0 AS \"offset\" FROM windows GROUP BY user_id, win, k // 4 HAVING count(*) >= 2",
)
def straight_line(spark, d):
    out = X.straight_line(windows(spark, d), ["user_id", "win"], "k", "value", 4).filter("n >= 2")
    return out.select("user_id", "win", "segment", "n", (F.round("slope", 5) + F.lit(0.0)).alias("slope"), (F.round("offset", 5) + F.lit(0.0)).alias("offset"))


@query("time_domain_features", f"WITH {CHANNEL_SQL} SELECT win, 'TD_' || channel || '_' || printf('%.3f', t / 10.0) || 'sec' AS feature, value AS x FROM channels WHERE t IN (1, 3)")
def time_domain_features(spark, d):
    return X.time_domain(channels(spark, d), ["win"], "channel", "t", "value", [1, 3], 10.0)


@query(
    "time_domain_differences",
    f"WITH {WINDOWS}, p AS (SELECT user_id, win, k, value FROM windows WHERE k IN (0, 4, 9)) SELECT a.user_id, a.win, 'd' || a.k || '_' || b.k AS feature, round(b.value - a.value, 6) + 0.0 AS x FROM p a JOIN p b ON a.user_id = b.user_id AND a.win = b.win AND a.k < b.k",
)
def time_domain_differences(spark, d):
    out = X.time_differences(windows(spark, d), ["user_id", "win"], "k", "value", [0, 4, 9]).filter("x IS NOT NULL")
    return out.select("user_id", "win", "feature", r6("x").alias("x"))


@query(
    "frequency_bands",
    f"""WITH {WINDOWS}, b AS (SELECT user_id, win, f, power(sum(value * cos(2 * pi() * f * k / 16)), 2) + power(sum(value * sin(2 * pi() * f * k / 16)), 2) AS p FROM windows, (SELECT unnest(range(9)) AS f) GROUP BY user_id, win, f HAVING count(*) = 16)
    SELECT user_id, win, round(10 * log10(greatest(sum(p) FILTER (f BETWEEN 1 AND 3), 1e-12)), 5) AS low, round(10 * log10(greatest(sum(p) FILTER (f BETWEEN 4 AND 8), 1e-12)), 5) AS high FROM b GROUP BY user_id, win""",
)
def frequency_bands(spark, d):
    out = X.bands(windows(spark, d), ["user_id", "win"], "k", "value", 16, {"low": (1, 4), "high": (4, 9)})
    return out.select("user_id", "win", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("evoked_average", f"WITH {WINDOWS} SELECT marker, k, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, count(*) AS n FROM windows GROUP BY marker, k")
def evoked_average(spark, d):
    return windows(spark, d).groupBy("marker", "k").agg(r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("sd"), F.count("*").alias("n"))


# ---- normalisation ----

_TRAIN = "id % 2 = 0"


def _norm_sql(parameters: str) -> str:
    return f"WITH {FEATURES}, t AS (SELECT * FROM features WHERE id % 2 = 0), p AS ({parameters}) SELECT id, f, round((x - shift) * factor, 6) + 0.0 AS x FROM features JOIN p USING (f)"


def _normed(spark, d, fit):
    df = features(spark, d)
    return N.apply(df, "f", "x", fit(df.filter(_TRAIN), "f", "x")).select("id", "f", r6("x").alias("x"))


@query("gaussian_norm", _norm_sql("SELECT f, avg(x) AS shift, CASE WHEN stddev_pop(x) < 1e-9 THEN 1.0 ELSE 1 / stddev_pop(x) END AS factor FROM t GROUP BY f"))
def gaussian_norm(spark, d):
    return _normed(spark, d, N.gaussian)


@query("outlier_norm", _norm_sql("SELECT f, quantile_cont(x, 0.05) AS shift, 1 / (quantile_cont(x, 0.95) - quantile_cont(x, 0.05)) AS factor FROM t GROUP BY f"))
def outlier_norm(spark, d):
    return _normed(spark, d, N.outlier)


@query(
    "histogram_norm",
    _norm_sql(
        """WITH r AS (SELECT f, min(x) AS lo, (max(x) - min(x)) / 3 AS st FROM t GROUP BY f), b AS (SELECT t.f, x, lo, st, least(floor((x - lo) / st), 2) AS bin FROM t JOIN r USING (f)), n AS (SELECT f, bin, count(*) AS n FROM b GROUP BY f, bin),
        m AS (SELECT f, min(bin) AS best FROM n WHERE (f, n) IN (SELECT (f, max(n)) FROM n GROUP BY f) GROUP BY f) SELECT b.f, avg(x) AS shift, 1 / stddev_pop(x) AS factor FROM b JOIN m USING (f) WHERE x BETWEEN lo + best * st AND lo + (best + 1) * st GROUP BY b.f"""
    ),
)
def histogram_norm(spark, d):
    return _normed(spark, d, N.histogram)


def _vector_sql(norm: str) -> str:
    return f"WITH {FEATURES}, n AS (SELECT id, {norm} AS norm FROM features GROUP BY id) SELECT id, f, round(x / norm, 6) + 0.0 AS x FROM features JOIN n USING (id)"


@query("l2_norm", _vector_sql("sqrt(sum(x * x))"))
def l2_norm(spark, d):
    return N.by_norm(features(spark, d), "id", "x", 2).select("id", "f", r6("x").alias("x"))


@query("inf_norm", _vector_sql("max(abs(x))"))
def inf_norm(spark, d):
    return N.by_norm(features(spark, d), "id", "x", "inf").select("id", "f", r6("x").alias("x"))


@query("l1_norm", _vector_sql("sum(abs(x))"))
def l1_norm(spark, d):
    return N.by_norm(features(spark, d), "id", "x", 1).select("id", "f", r6("x").alias("x"))


@query("p_norm", _vector_sql("power(sum(power(abs(x), 3)), 1.0 / 3)"))
def p_norm(spark, d):
    return N.by_norm(features(spark, d), "id", "x", 3).select("id", "f", r6("x").alias("x"))
