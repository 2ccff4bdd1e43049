"""Queries of classifiers and spatial filters, and the flagship chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.functions.expr import r6, spread_hash
from sigmill.operators import features as X
from sigmill.operators import learners as L
from sigmill.operators import metrics as M
from sigmill.operators import search as H
from sigmill.operators import signal as S
from sigmill.operators import windower as W
from sigmill.plans.inputs import CHANNELS, RECORDS, records, samples, table
from sigmill.plans.query import query


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def _scored(df, model, positive, negative):
    return df.withColumn("score", model.score("x")).select("id", "label", F.round("score", 5).alias("score"), F.when(F.col("score") > 0, positive).otherwise(negative).alias("predicted"))


@query("lda")
def lda(spark, d):
    v = _vectors(spark, d)
    return _scored(v, L.lda(L.moments(v.filter("id % 2 = 0"), "label", "x"), "even", "odd"), "even", "odd")


@query("qda")
def qda(spark, d):
    v = _vectors(spark, d)
    return _scored(v, L.qda(L.moments(v.filter("id % 2 = 0"), "label", "x"), "even", "odd"), "even", "odd")


@query("ridge_classifier")
def ridge_classifier(spark, d):
    v = _vectors(spark, d)
    return _scored(v, L.ridge_classifier(L.moments(v.filter("id % 2 = 0"), "label", "x"), "even", "odd"), "even", "odd")


@query("linear_svm")
def linear_svm(spark, d):
    v = _vectors(spark, d)
    return _scored(v, L.svm(v.filter("id % 2 = 0"), "label", "x", "even"), "even", "odd")


@query("pca")
def pca(spark, d):
    v = _vectors(spark, d)
    return L.project(v, "x", L.pca(L.moments(v, "label", "x"), 4)).select("id", F.transform("projected", lambda x: F.round(x, 5)).alias("projected"))


@query("csp")
def csp(spark, d):
    v = _vectors(spark, d)
    return L.project(v, "x", L.csp(L.moments(v.filter("id % 2 = 0"), "label", "x"), "even", 4)).select("id", F.transform("projected", lambda x: F.round(x, 5)).alias("projected"))


@query("fda")
def fda(spark, d):
    v = _vectors(spark, d)
    return L.project(v, "x", L.fda(L.moments(v.filter("id % 2 = 0"), "label", "x"), 1)).select("id", F.transform("projected", lambda x: F.round(x, 5)).alias("projected"))


_PAIRS = [(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i:]]


@query("csp_covariance", f"WITH {RECORDS} SELECT label, count(*) AS n, " + ", ".join(f'round(avg({a} * {b}), 3) AS "{a}_{b}"' for a, b in _PAIRS) + " FROM records GROUP BY label")
def csp_covariance(spark, d):
    return records(spark, d).groupBy("label").agg(F.count("*").alias("n"), *(F.round(F.avg(F.col(a) * F.col(b)), 3).alias(f"{a}_{b}") for a, b in _PAIRS))


def chain(spark: SparkSession, sf_dir: str, folds: int = 3) -> DataFrame:
    """Windows around purchases against windows around views, both without errors near them: standardise, features,
    folds, a discriminant on each training part, metrics of each fold. Folds are columns: one pass of sums, one small solve
    for each fold, one pass of scores."""
    s = samples(spark, sf_dir)
    away = (W.Near("error", 1, 1),)
    defs = [W.WindowDef("buy", "target", "purchase", -3, 4, exclude=away), W.WindowDef("look", "standard", "view", -3, 4, exclude=away)]
    w = W.extract(s, W.marker_windows(s, defs, ["user_id"]), ["user_id"], "value")
    key = ["user_id", "m", "label"]
    z = S.standardize(w, "value", key)
    stats, line = X.statistics(z, key, "value", 3), X.straight_line(z, key, "k", "value", 4)
    slopes = line.groupBy(*key).pivot("segment", [0, 1]).agg(F.first("slope"))
    f = stats.join(slopes, key).select(*key, F.array(*(F.coalesce(c, F.lit(0.0)) for c in ("central_3", "median", "min", "max", "`0`", "`1`"))).alias("x"))
    f = f.withColumn("fold", F.pmod(spread_hash(F.pmod("user_id", F.lit(1 << 32)) * 1_000_003 + F.col("m")), F.lit(folds)))
    parts = H.fold_moments(f, "fold", "label", "x")  # one pass for all folds; each training set is all but one
    hit = F.lit(None).cast("double")
    for k in parts:
        hit = F.when(F.col("fold") == int(k), L.lda(H.without(parts, k), "target", "standard").score("x")).otherwise(hit)
    out = f.withColumn("predicted", F.when(hit > 0, "target").otherwise("standard"))
    return M.from_counts(M.confusion(out, ["fold"], "label", "predicted", "target"))


@query("flagship_chain")
def flagship_chain(spark, d):
    out = chain(spark, d)
    return out.select("fold", "TP", "TN", "FP", "FN", r6("Balanced_accuracy").alias("Balanced_accuracy"), r6("F_measure").alias("F_measure"))


@query("ica")
def ica(spark, d):
    v = _vectors(spark, d)
    return L.project(v, "x", L.ica(v, "x", 3)).select("id", F.transform("projected", lambda x: F.round(x, 4)).alias("projected"))
