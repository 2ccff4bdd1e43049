"""Metrics of predictions as grouped aggregation: one pass over the rows, then arithmetic on one row for each group.

Groups are the columns that tell experiments apart (data set, parameters, run, fold). Every metric is a function of a few
sums, so partial aggregation does most of the work before the shuffle, and merging splits is adding their sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions.expr import correlation, safe_ratio
from sigmill.operators.segments import running, value_ranges


def confusion(df: DataFrame, groups: list[str], truth: str, predicted: str, positive) -> DataFrame:
    t, p = F.col(truth) == positive, F.col(predicted) == positive
    n = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*groups).agg(n(t & p).alias("TP"), n(~t & ~p).alias("TN"), n(~t & p).alias("FP"), n(t & ~p).alias("FN"))


def from_counts(counts: DataFrame) -> DataFrame:
    """All metrics of TP, TN, FP and FN, with the guards for empty classes: a rate without rows is 0, and so are the correlation
    (Matthews) with an empty margin and Kappa where chance explains all."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("TP", "TN", "FP", "FN"))
    p, n = tp + fn, tn + fp
    one = F.lit(1.0)
    tpr, tnr = F.when(tp == 0, 0.0).otherwise(tp / p), F.when(tn == 0, 0.0).otherwise(tn / n)
    precision, negative = F.when(tp == 0, 0.0).otherwise(tp / (tp + fp)), F.when(tn == 0, 0.0).otherwise(tn / (tn + fn))
    f = lambda a, b: safe_ratio(2 * a * b, a + b)
    total = p + n
    den = (tp + fp) * p * n * (tn + fn)
    chance = F.coalesce(F.try_divide(p * (tp + fp) + n * (tn + fn), total), F.lit(0.0))
    kappa = F.when(total == chance, 0.0).otherwise((tp + tn - chance) / (total - chance))
    out = {
        "True_positive_rate": tpr, "True_negative_rate": tnr, "False_positive_rate": one - tnr, "False_negative_rate": one - tpr,
        "IR_precision": precision, "Non_IR_precision": negative, "F_measure": f(precision, tpr), "Non_IR_F_measure": f(negative, tnr),
        "Percent_correct": safe_ratio(100 * (tp + tn), total), "Percent_incorrect": F.when(total == 0, 100.0).otherwise(100 - 100 * (tp + tn) / total),
        "Balanced_accuracy": (tpr + tnr) / 2, "Weighted_accuracy": 0.7 * tpr + 0.3 * tnr, "ROC_measure": F.sqrt((tpr * tpr + tnr * tnr) / 2), "Gmean": F.sqrt(F.abs(tpr * tnr)),
        "Matthews": F.when(den <= 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(den)), "Kappa": kappa,
    }
    return counts.withColumns(out)


def merge_splits(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Counts added over splits, metrics anew."""
    return from_counts(counts.groupBy(*groups).agg(*(F.sum(c).alias(c) for c in ("TP", "TN", "FP", "FN"))))


def soft_confusion(df: DataFrame, groups: list[str], truth: str, score: str, positive, kind: str = "soft") -> DataFrame:
    """Counts weighted by how sure the score is: cut at 1, polynomial, or logistic."""
    s = F.least(F.abs(F.col(score)), F.lit(1.0))
    weight = {"soft": s, "pol": s * s * (3 - 2 * s), "k": 2 / (1 + F.exp(-4 * F.abs(F.col(score)))) - 1}[kind]
    t, p = F.col(truth) == positive, F.col(score) > 0
    n = lambda c: F.sum(F.when(c, weight).otherwise(0.0))
    return df.groupBy(*groups).agg(n(t & p).alias("TP"), n(~t & ~p).alias("TN"), n(~t & p).alias("FP"), n(t & ~p).alias("FN"))


def roc_points(df: DataFrame, groups: list[str], truth: str, score: str, positive, decimals: int = 3) -> DataFrame:
    """One point for each distinct rounded score, from high to low: cumulative hits and false alarms.

    Scores are counted before they are ordered, and running sums go over ranges of scores, then inside a range, so neither
    a group's rows nor its distinct scores are in one task whole. A null score comes last; a null group is a group.
    """
    t = (F.col(truth) == positive).cast("long")
    ties = df.groupBy(*groups, F.round(F.col(score), decimals).alias("threshold")).agg(F.sum(t).alias("p"), F.sum(1 - t).alias("n"))
    ties = ties.withColumn("_k", F.struct(F.lit(0).alias("all"), *groups))  # as fields, nulls are equal
    totals = ties.groupBy("_k").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    run = running(value_ranges(ties, ["_k"], "threshold", "_r"), ["_k"], -F.col("_r"), [F.desc("threshold")], {"tp": (F.sum, F.col("p")), "fp": (F.sum, F.col("n"))})
    return run.join(F.broadcast(totals), "_k").drop("_k", "_r")


def auc(df: DataFrame, groups: list[str], truth: str, score: str, positive, decimals: int = 3) -> DataFrame:
    """Trapezoids over the points; 1 if a class is empty."""
    points = roc_points(df, groups, truth, score, positive, decimals)
    area = F.sum(F.col("n") * (2 * F.col("tp") - F.col("p")) / 2.0)
    out = points.groupBy(*groups).agg(area.alias("_a"), F.max("positives").alias("_p"), F.max("negatives").alias("_n"))
    return out.select(*groups, F.when((F.col("_p") == 0) | (F.col("_n") == 0), 1.0).otherwise(F.col("_a") / (F.col("_p") * F.col("_n"))).alias("AUC"))


def mutual_information(counts: DataFrame) -> DataFrame:
    """In bits, from TP, TN, FP and FN; also as a share of the entropy of the truth."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("TP", "TN", "FP", "FN"))
    total = tp + tn + fp + fn
    term = lambda x, a, b: F.when(x == 0, 0.0).otherwise(x / total * F.log2(x * total / (a * b)))
    mi = term(tp, tp + fn, tp + fp) + term(fn, tp + fn, tn + fn) + term(fp, tn + fp, tp + fp) + term(tn, tn + fp, tn + fn)
    h = lambda x: F.when(x == 0, 0.0).otherwise(-x / total * F.log2(x / total))
    entropy = h(tp + fn) + h(tn + fp)
    return counts.withColumn("MI", mi).withColumn("NMI", F.when(entropy == 0, 0.0).otherwise(mi / entropy))


def losses(df: DataFrame, groups: list[str], truth: str, score: str, positive, limit: float = 2.0) -> DataFrame:
    """Hinge losses (L1, L2, cut at limit) and their means by class."""
    y = F.when(F.col(truth) == positive, 1.0).otherwise(-1.0)
    hinge = F.greatest(1 - y * F.col(score), F.lit(0.0))
    kinds = {"L1": hinge, "L2": hinge * hinge, "L1_restricted": F.least(hinge, F.lit(limit)), "plain_L1": F.abs(F.col(score) - y), "plain_L2": F.pow(F.col(score) - y, 2)}
    df = df.withColumns({f"_{k}": v for k, v in kinds.items()} | {"_pos": F.col(truth) == positive})
    out = df.groupBy(*groups).agg(*(F.avg(f"_{k}").alias(k) for k in kinds), F.avg(F.when(F.col("_pos"), F.col("_L1"))).alias("_a"), F.avg(F.when(~F.col("_pos"), F.col("_L1"))).alias("_b"))
    return out.withColumn("L1_balanced", (F.coalesce("_a", F.lit(0.0)) + F.coalesce("_b", F.lit(0.0))) / 2).drop("_a", "_b")


def margin_losses(df: DataFrame, groups: list[str], truth: str, score: str, positive, limit: float = 2.0, reach: float = 2.0) -> DataFrame:
    """Losses of the margin m = y * score, linear (L1) and squared (L2): below 1 (SVM), away from 1 (plain), outside [1, reach]
    (RMM); each also restricted (the distance cut at limit), as a mean over rows and as the mean of both classes' means
    (balanced; a class without rows adds 0)."""
    m = F.when(F.col(truth) == positive, F.col(score)).otherwise(-F.col(score))
    zero = F.lit(0.0)
    distance = {"SVM": F.greatest(1 - m, zero), "plain": F.abs(m - 1), "RMM": F.greatest(1 - m, m - reach, zero)}
    terms = {f"{cut}L{power}_{kind}": F.pow(F.least(x, F.lit(limit)) if cut else x, F.lit(power)) for kind, x in distance.items() for cut in ("", "restr_") for power in (1, 2)}
    df = df.withColumns({f"_{k}": v for k, v in terms.items()} | {"_pos": F.col(truth) == positive})
    by_class = lambda k, c: F.coalesce(F.avg(F.when(c, F.col(f"_{k}"))), zero)
    balanced = [((by_class(k, F.col("_pos")) + by_class(k, ~F.col("_pos"))) / 2).alias(f"balanced_{k}") for k in terms]
    return df.groupBy(*groups).agg(*(F.avg(f"_{k}").alias(k) for k in terms), *balanced)


def multiclass(df: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy, macro F and the multiclass correlation from the table of true and predicted labels."""
    cells = df.groupBy(*groups, F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    by_t = cells.select(*groups, F.col("t").alias("c"), F.col("n").alias("true"), F.lit(0).cast("long").alias("pred"), hit.alias("hit"))
    by_p = cells.select(*groups, F.col("p").alias("c"), F.lit(0).cast("long").alias("true"), F.col("n").alias("pred"), F.lit(0).cast("long").alias("hit"))
    classes = by_t.unionByName(by_p).groupBy(*groups, "c").agg(F.sum("true").alias("true"), F.sum("pred").alias("pred"), F.sum("hit").alias("hit"))
    recall = F.when(F.col("true") == 0, 1.0).otherwise(F.col("hit") / F.col("true"))
    f = F.when(F.col("true") + F.col("pred") == 0, 1.0).otherwise(2 * F.col("hit") / (F.col("true") + F.col("pred")))
    sums = classes.groupBy(*groups).agg(
        F.avg(recall).alias("Balanced_accuracy"), F.avg(f).alias("macro_F"), F.sum("hit").alias("_h"), F.sum("true").alias("_n"),
        F.sum(F.col("true") * F.col("pred")).alias("_tp"), F.sum(F.col("true") * F.col("true")).alias("_tt"), F.sum(F.col("pred") * F.col("pred")).alias("_pp"), F.count("*").alias("classes"),
    )
    n2 = F.col("_n") * F.col("_n")
    den = F.sqrt((n2 - F.col("_tt")).cast("double")) * F.sqrt((n2 - F.col("_pp")).cast("double"))
    return sums.select(*groups, "classes", F.try_divide("_h", "_n").alias("Accuracy"), "Balanced_accuracy", "macro_F", F.when(den == 0, 0.0).otherwise((F.col("_n") * F.col("_h") - F.col("_tp")) / den).alias("Matthews"))


def regression(df: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    """Errors of each group; the groups' means are broadcast, so that no group's rows are dealt to one task. Where the truth doesn't vary, what is relative to its spread (RSE, RAE, correlation) is null."""
    d = F.col(predicted) - F.col(truth)
    every = df.groupBy(*groups).agg(F.avg(truth).alias("_m"))
    j = df.join(F.broadcast(every), groups) if groups else df.crossJoin(F.broadcast(every))
    return j.groupBy(*groups).agg(
        F.avg(d * d).alias("MSE"), F.sqrt(F.avg(d * d)).alias("RMSE"), F.avg(F.abs(d)).alias("MAE"), F.try_divide(F.avg(d * d), F.var_pop(truth)).alias("RSE"), F.try_divide(F.avg(F.abs(d)), F.avg(F.abs(F.col(truth) - F.col("_m")))).alias("RAE"), correlation(truth, predicted).alias("correlation")
    )


def regression_vectors(df: DataFrame, groups: list[str], truth: str, predicted: str) -> DataFrame:
    """Regression metrics of vectors, a row for each component (its number), for all components' values together (micro) and
    for the mean over components (macro)."""
    values = df.select(*groups, F.posexplode(F.arrays_zip(F.col(truth).alias("a"), F.col(predicted).alias("p"))).alias("_i", "_v"))
    both = values.select(*groups, F.explode(F.array(F.col("_i").cast("string"), F.lit("micro"))).alias("component"), F.col("_v.a").cast("double").alias("_a"), F.col("_v.p").cast("double").alias("_p"))
    out = regression(both, [*groups, "component"], "_a", "_p").withColumn("RRSE", F.sqrt("RSE"))
    names = [c for c in out.columns if c not in (*groups, "component")]
    macro = out.filter("component <> 'micro'").groupBy(*groups).agg(*(F.avg(c).alias(c) for c in names)).withColumn("component", F.lit("macro"))
    return out.unionByName(macro)


def average(df: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation of metrics over splits."""
    return df.groupBy(*groups).agg(*(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))

