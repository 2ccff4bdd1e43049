"""Combining predictors, and transforming scores. Predictions are rows (id, predictor, label, score)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions.expr import spread_hash
from sigmill.operators.learners import kept
from sigmill.operators.segments import running, value_ranges


def vote(df: DataFrame, row: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Majority label; ties go to the larger sum of scores, then to the smaller label. score: the mean of all."""
    mean = df.groupBy(*row).agg(F.avg(score).alias("score"))
    n = df.groupBy(*row, label).agg(F.count("*").alias("_n"), F.sum(F.abs(F.col(score))).alias("_s"))
    w = Window.partitionBy(*row).orderBy(F.desc("_n"), F.desc("_s"), label)
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*row, label).join(mean, row)


def vote_by_score(df: DataFrame, row: list[str], label: str = "label", score: str = "score", magnitude: bool = True) -> DataFrame:
    """Label with the largest sum of scores."""
    s = df.groupBy(*row, label).agg(F.sum(F.abs(F.col(score)) if magnitude else F.col(score)).alias("score"))
    w = Window.partitionBy(*row).orderBy(F.desc("score"), label)
    return s.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def precision_weights(train: DataFrame, predictor: str = "predictor", label: str = "label", truth: str = "truth") -> DataFrame:
    """weight of each predictor's label: its precision there, normalised over predictors."""
    p = train.groupBy(predictor, label).agg(F.avg((F.col(label) == F.col(truth)).cast("double")).alias("_p"))
    total = F.sum("_p").over(Window.partitionBy(label))
    return p.select(predictor, label, F.when(total > 0, F.col("_p") / total).otherwise(0.0).alias("weight"))


def weighted_vote(df: DataFrame, weights: DataFrame, row: list[str], positive, required: float = 0.5, predictor: str = "predictor", label: str = "label") -> DataFrame:
    """Share of the weight that votes for the positive label, and whether it reaches the required one."""
    w = df.join(F.broadcast(weights), [predictor, label], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    s = w.groupBy(*row).agg(F.sum(F.when(F.col(label) == positive, F.col("weight")).otherwise(0.0)).alias("_a"), F.sum("weight").alias("_b"))
    share = F.when(F.col("_b") == 0, 0.0).otherwise(F.col("_a") / F.col("_b"))
    return s.select(*row, share.alias("share"), (share >= required).alias("positive"))


def champion(train: DataFrame, positive, predictor: str = "predictor", label: str = "label", truth: str = "truth") -> DataFrame:
    """The predictor with the best training F-measure (the first by name of equals; one that neither finds nor
    misses a positive has none, and comes last)."""
    p, t = F.col(label) == positive, F.col(truth) == positive
    n = lambda c: F.sum(c.cast("double"))
    f = train.groupBy(predictor).agg(F.try_divide(2 * n(p & t), n(p) + n(t)).alias("f"))
    return f.orderBy(F.desc_nulls_last("f"), predictor).limit(1)


def knn_hamming(df: DataFrame, train: DataFrame, row: str, votes: list[str], truth: str, k: int) -> DataFrame:
    """Majority truth of the k nearest training rows by Hamming distance of the votes.

    Rows with equal votes are one pattern on either side, so patterns meet, not rows: there are at most as many as label
    combinations. Training patterns carry how often each truth stands with them; ties of distance are taken in whole.
    """
    known = train.groupBy(*votes, F.col(truth).alias("_t")).agg(F.count("*").alias("_n"))
    asked = df.select(*votes).distinct()
    k_side = known.select(*(F.col(v).alias(f"_{v}") for v in votes), "_t", "_n")
    pairs = asked.crossJoin(k_side).withColumn("_d", sum((F.col(v) != F.col(f"_{v}")).cast("int") for v in votes))
    by_distance = pairs.groupBy(*votes, "_d").agg(F.sum("_n").alias("_m"))
    before = F.coalesce(F.sum("_m").over(Window.partitionBy(*votes).orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = by_distance.withColumn("_before", before).filter(F.col("_before") < k).groupBy(*votes).agg(F.max("_d").alias("_reach"))
    n = pairs.join(reach, votes).filter("_d <= _reach").groupBy(*votes, "_t").agg(F.sum("_n").alias("_c"))
    best = n.withColumn("_r", F.row_number().over(Window.partitionBy(*votes).orderBy(F.desc("_c"), "_t"))).filter("_r = 1")
    return df.join(best.select(*votes, F.col("_t").alias("predicted")), votes).select(row, "predicted")


def ridge_weights(train: DataFrame, votes: list[str], truth: str, tau: float = 1.0) -> np.ndarray:
    """(A'A + tau I)^-1 A'b over numeric votes: one aggregate of sums of products, solved on the driver."""
    n = len(votes)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"a{i}_{j}") for i, a in enumerate(votes) for j, b in enumerate(votes) if j >= i] + [F.sum(F.col(a) * F.col(truth)).alias(f"b{i}") for i, a in enumerate(votes)]
    r = train.agg(*sums).first()
    a = np.array([[float(r[f"a{min(i, j)}_{max(i, j)}"] or 0) for j in range(n)] for i in range(n)])
    return np.linalg.solve(a + tau * np.eye(n), np.array([float(r[f"b{i}"] or 0) for i in range(n)]))


def sigmoid(df: DataFrame, score: str = "score", a: float = -1.0, b: float = 0.0) -> DataFrame:
    """1 / (1 + exp(a s + b))"""
    return df.withColumn(score, 1 / (1 + F.exp(a * F.col(score) + b)))


def linear(df: DataFrame, score: str = "score", offset: float = 0.0, scaling: float = 1.0) -> DataFrame:
    return df.withColumn(score, (F.col(score) + offset) * scaling)


def linear_fit(df: DataFrame, group: list[str], score: str = "score") -> DataFrame:
    """Maps the largest magnitude on each side of 0 to 0 and 1, and 0 to 0.5."""
    ends = df.groupBy(*group).agg(F.abs(F.min(score)).alias("_low"), F.abs(F.max(score)).alias("_high"))
    s, low, high = F.col(score), F.col("_low"), F.col("_high")
    out = df.join(F.broadcast(ends), group).withColumn(score, F.when(s < 0, 0.5 + 0.5 * s / F.when(low == 0, 1.0).otherwise(low)).otherwise(0.5 + 0.5 * s / F.when(high == 0, 1.0).otherwise(high)))
    return out.drop("_low", "_high")


def threshold_sweep(df: DataFrame, group: list[str], truth: str, positive, score: str = "score") -> DataFrame:
    """Balanced accuracy of each distinct score taken as threshold (predicted positive from it on), and the best, the lowest of equals.

    Scores are counted by value first; running sums go over ranges that follow how the scores are spread, then inside a
    range, so no group is ever in one task whole. The value is null where a class is missing. Rows with a null score or group are left out.
    """
    t = (F.col(truth) == positive).cast("long")
    n = df.groupBy(*group, F.col(score).alias("threshold")).agg(F.sum(t).alias("_p"), F.sum(1 - t).alias("_n"))
    totals = n.groupBy(*group).agg(F.sum("_p").alias("_pt"), F.sum("_n").alias("_nt"))
    ranged = value_ranges(n.filter(F.col("threshold").isNotNull()), group, "threshold", "_r")
    run = running(ranged, group, -F.col("_r"), [F.desc("threshold")], {"_tp": (F.sum, F.col("_p")), "_fp": (F.sum, F.col("_n"))}).join(F.broadcast(totals), group)
    out = run.withColumn("value", (F.try_divide("_tp", "_pt") + 1 - F.try_divide("_fp", "_nt")) / 2)
    best = out.groupBy(*group).agg(F.max(F.struct(F.round("value", 12).alias("v"), (-F.col("threshold")).alias("m")))["m"].alias("_m"))
    return out.join(F.broadcast(best), group).select(*group, "threshold", "value", (F.col("threshold") == -F.col("_m")).alias("best"))


def platt(df: DataFrame, truth: str, positive, score: str = "score", rounds: int = 30) -> tuple[float, float]:
    """A and B of 1 / (1 + exp(A s + B)) by Newton's method with smoothed targets; each round is one aggregate over all
    rows, of which class and score are kept by the executors (spilled to disk, recomputed where one is lost) meanwhile."""
    df = df.select(truth, score)
    with kept(df):
        return _platt(df, truth, positive, score, rounds)


def _platt(df: DataFrame, truth: str, positive, score: str, rounds: int) -> tuple[float, float]:
    y = F.col(truth) == positive
    r = df.agg(F.sum(y.cast("long")).alias("p"), F.count("*").alias("n")).first()
    p, n = r["p"] or 0, (r["n"] or 0) - (r["p"] or 0)
    target = F.when(y, (p + 1) / (p + 2)).otherwise(1 / (n + 2))
    a, b = 0.0, float(np.log((n + 1) / (p + 1)))
    for _ in range(rounds):
        q = 1 / (1 + F.exp(a * F.col(score) + b))
        d, h, s = target - q, q * (1 - q), F.col(score)
        g = df.agg(F.sum(s * d).alias("ga"), F.sum(d).alias("gb"), F.sum(s * s * h).alias("aa"), F.sum(s * h).alias("ab"), F.sum(h).alias("bb")).first()
        if g["bb"] is None or abs(g["ga"]) + abs(g["gb"]) < 1e-7 * (p + n):
            break
        step = np.linalg.solve([[g["aa"] + 1e-9, g["ab"]], [g["ab"], g["bb"] + 1e-9]], [g["ga"], g["gb"]])
        a, b = a - float(step[0]), b - float(step[1])
    return a, b


def random_labels(df: DataFrame, row_id: str, labels: list, name: str = "predicted") -> DataFrame:
    """One of the labels, each with the same chance; the row's id fixes which."""
    return df.withColumn(name, F.array(*map(F.lit, labels))[F.floor(spread_hash(row_id) * len(labels) / float(1 << 32)).cast("int")])
