"""Every metric and normalisation on a constant truth, a missing class, a constant signal and no rows, in a session as it comes."""

import pytest
from pyspark.sql import functions as F

from sigmill.operators import ensemble, metrics, normalize, signal, thresholds

SCHEMA = "g string, truth int, predicted int, score double"
ROWS = [("no positives", 0, 0, 0.2), ("no positives", 0, 1, 0.2), ("no negatives", 1, 1, 0.7), ("no negatives", 1, 0, -1.5), ("both", 0, 0, 0.0), ("both", 1, 1, 3.0), ("one", 1, 1, 0.0), ("nulls", None, None, None), ("half null", 1, None, None)]

METRICS = {
    "confusion": lambda df: metrics.from_counts(metrics.confusion(df, ["g"], "truth", "predicted", 1)),
    "merged": lambda df: metrics.merge_splits(metrics.confusion(df, ["g", "predicted"], "truth", "predicted", 1), ["g"]),
    **{f"soft {k}": lambda df, k=k: metrics.from_counts(metrics.soft_confusion(df, ["g"], "truth", "score", 1, k)) for k in ("soft", "pol", "k")},
    "roc": lambda df: metrics.roc_points(df, ["g"], "truth", "score", 1),
    "auc": lambda df: metrics.auc(df, ["g"], "truth", "score", 1),
    "information": lambda df: metrics.mutual_information(metrics.confusion(df, ["g"], "truth", "predicted", 1)),
    "margin losses": lambda df: metrics.margin_losses(df, ["g"], "truth", "score", 1),
    "multiclass": lambda df: metrics.multiclass(df, ["g"], "truth", "predicted"),
    "regression": lambda df: metrics.regression(df, ["g"], "truth", "predicted"),
    "regression of all": lambda df: metrics.regression(df, [], "truth", "predicted"),
    "regression of vectors": lambda df: metrics.regression_vectors(df.withColumns({"a": F.array("truth", "score"), "b": F.array("predicted", F.lit(1.0))}), ["g"], "a", "b"),
    "champion": lambda df: ensemble.champion(df, 1, "g", "predicted", "truth"),
    "champion without positives": lambda df: ensemble.champion(df.filter("g = 'no positives' AND predicted = 0"), 1, "g", "predicted", "truth"),
    "precision": lambda df: ensemble.precision_weights(df, "g", "predicted", "truth"),
    "vote": lambda df: ensemble.vote(df, ["g"], "predicted", "score"),
    **{f"threshold {m}": lambda df, m=m: thresholds.best_threshold(df, ["g"], "truth", 1, "score", m) for m in thresholds.METRICS},
    "sweep": lambda df: ensemble.threshold_sweep(df, ["g"], "truth", 1),
    **{k: lambda df, k=k: getattr(normalize, k)(df, "g", "score") for k in ("outlier", "gaussian", "histogram")},
    "vector norm": lambda df: normalize.by_norm(df, "g", "score"),
    "one sample": lambda df: signal.window_function(df.withColumn("t", F.lit(0)), "score", "t", 1),
}


@pytest.mark.parametrize("name", sorted(METRICS))
def test_no_group_takes_the_job_down(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for some in (df, df.filter("false"), *(df.filter(F.col("g") == g) for g in ("no positives", "nulls"))):
        METRICS[name](some).collect()


def test_guards(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = {x.g: x for x in metrics.regression(df, ["g"], "truth", "predicted").collect()}
    assert r["no positives"].MSE == 0.5 and r["no positives"].RSE is None and r["no positives"].RAE is None and r["no positives"].correlation is None
    assert r["both"].RSE == 0 and r["both"].correlation == pytest.approx(1)
    c = {x.g: x for x in METRICS["confusion"](df).collect()}
    assert c["no positives"].Matthews == 0 and c["no negatives"].Matthews == 0 and c["both"].Matthews == 1
    assert c["one"].Kappa == 0 and c["no negatives"].Percent_correct == 50
    assert ensemble.champion(df, 1, "g", "predicted", "truth").first().g in ("both", "one")
    m = {x.g: x for x in METRICS["multiclass"](df).collect()}
    assert m["one"].Matthews == 0 and m["both"].Matthews == pytest.approx(1)
    assert metrics.from_counts(spark.createDataFrame([(0, 0, 0, 0)], "TP long, TN long, FP long, FN long")).first().Kappa == 0
