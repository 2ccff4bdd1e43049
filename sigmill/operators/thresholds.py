"""Decisions by thresholds: the best one for a metric, onset detection by channel, and sequences of windows as trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.operators.segments import running, value_ranges

#: Metrics as functions of the true and false positive, and true and false negative counts; null where a class is missing.
METRICS = {
    "Balanced_accuracy": lambda tp, fp, tn, fn: (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2,
    "F_measure": lambda tp, fp, tn, fn: F.try_divide(2 * tp, 2 * tp + fp + fn),
    "Percent_correct": lambda tp, fp, tn, fn: F.try_divide(tp + tn, tp + fp + tn + fn) * 100,
    "Matthews": lambda tp, fp, tn, fn: F.coalesce((tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0)), F.lit(0.0)),
}


def best_threshold(df: DataFrame, group: list[str], truth: str, positive, score: str = "score", metric: str = "Balanced_accuracy", order: str | None = None) -> DataFrame:
    """For each group the threshold that maximises the metric.

    A threshold lies at a score: that score and all below it count as negative. The first maximum counts. Between two
    other scores the threshold is the vertex of the parabola through it and its neighbours, at either end the score.
    Scores are counted by value first; the running sums then go over distinct values in two levels: totals of ranges that
    follow how the scores are spread, and sums within a range, so no group is ever in one task whole.
    """
    y = (F.col(truth) == positive).cast("double")
    n = value_ranges(df.filter(F.col(score).isNotNull()).groupBy(*group, F.col(score).alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n")), group, "s", "_r")
    before = Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    ranges = n.groupBy(*group, "_r").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"), F.min("s").alias("_low"), F.max("s").alias("_high"))
    ranges = ranges.select(*group, "_r", *(F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"{c}b") for c in ("_p", "_n")), *(F.sum(c).over(every).alias(f"{c}t") for c in ("_p", "_n")), F.lag("_high").over(Window.partitionBy(*group).orderBy("_r")).alias("_prev"), F.lead("_low").over(Window.partitionBy(*group).orderBy("_r")).alias("_next"))
    within = Window.partitionBy(*group, "_r").orderBy("s")
    run = n.join(ranges, [*group, "_r"]).withColumns({"fn": F.col("_pb") + F.sum("p").over(within), "tn": F.col("_nb") + F.sum("n").over(within)})
    value = METRICS[metric](F.col("_pt") - F.col("fn"), F.col("_nt") - F.col("tn"), F.col("tn"), F.col("fn"))
    run = run.withColumns({"value": value, "left": F.coalesce(F.lag("s").over(within), "_prev"), "right": F.coalesce(F.lead("s").over(within), "_next")})
    top = run.groupBy(*group).agg(F.max(F.struct(F.round("value", 12).alias("v"), (-F.col("s")).alias("m"), F.struct("s", "value", "left", "right").alias("at")))["at"].alias("at"))
    top = top.select(*group, "at.*")
    # the values of both neighbours, by equality with their scores
    side = run.select(*group, F.col("s").alias("_s"), F.col("value").alias("_v"))
    lr = top.join(side.withColumnsRenamed({"_s": "left", "_v": "vl"}), [*group, "left"], "left").join(side.withColumnsRenamed({"_s": "right", "_v": "vr"}), [*group, "right"], "left")
    return lr.select(*group, vertex(F.col("left"), F.col("vl"), F.col("s"), F.col("value"), F.col("right"), F.col("vr")).alias("threshold"), "value")


def vertex(x1: Column, y1: Column, x2: Column, y2: Column, x3: Column, y3: Column) -> Column:
    """Where the parabola through three points has its extremum; the middle point if one is missing or they lie on a line."""
    a, b = (x2 - x1) * (y2 - y3), (x2 - x3) * (y2 - y1)
    d = a - b
    return F.when(y1.isNull() | y3.isNull() | (F.abs(d) < 1e-300), x2).otherwise(x2 - ((x2 - x1) * a - (x2 - x3) * b) / (2 * d))


def shift_to_threshold(df: DataFrame, thresholds: DataFrame, group: list[str], score: str = "score", at: float = 0.0) -> DataFrame:
    """Scores moved so that each group's threshold lies at ``at``."""
    return df.join(F.broadcast(thresholds.select(*group, "threshold")), group).withColumn(score, F.col(score) - (F.col("threshold") - at)).drop("threshold")


def onset_classifier(df: DataFrame, window: list[str], channel: str, onset: str, labels: tuple, least: int = 1) -> DataFrame:
    """label and prediction (its number) of each window: the second label if at least so many channels have an onset."""
    any_ = df.groupBy(*window, channel).agg(F.max((F.col(onset) != 0).cast("int")).alias("_any"))
    n = any_.groupBy(*window).agg(F.sum("_any").alias("_n"))
    hit = F.col("_n") >= least
    return n.select(*window, F.when(hit, labels[1]).otherwise(labels[0]).alias("label"), hit.cast("double").alias("prediction"))


def trials(df: DataFrame, key: list[str], start: str, end: str, gap: float, bucket: Column) -> DataFrame:
    """Adds trial (from 1) and place (in the trial, from 1): a new one begins where a window starts more than gap after the
    end of the one before. bucket is a coarse, monotone function of the start that bounds a sort, so neither a stream nor a
    trial has to fit a task."""
    order = [start, end]
    last = running(df, key, bucket, order, {"_last": (F.max, F.struct(start, end)), "_at": (F.sum, F.lit(1).cast("long"))}, itself=False)
    last = last.withColumn("_at", F.coalesce("_at", F.lit(0).cast("long"))).withColumn("_new", F.coalesce(F.col(start) - F.col("_last")[end] > gap, F.lit(True)))
    out = running(last, key, bucket, order, {"trial": (F.sum, F.col("_new").cast("long")), "_first": (F.max, F.when(F.col("_new"), F.col("_at")))})
    return out.withColumn("place", F.col("_at") - F.col("_first") + 1).drop("_last", "_at", "_new", "_first")


def relabel_by_change(df: DataFrame, trial: list[str], place: str, change: int, before, after, uncertain: tuple[int, int] | None = None) -> DataFrame:
    """truth: one label up to the change point of a trial and the other from it on, without the uncertain places around it."""
    at = F.col(place) - change
    out = df.withColumn("truth", F.when(at < 0, before).otherwise(after))
    return out if uncertain is None else out.filter((at < uncertain[0]) | (at >= uncertain[1]))


def mean_classifier_left_out(df: DataFrame, group: list[str], truth: str, positive, score: str = "score") -> DataFrame:
    """predicted: the class whose mean score is nearer, with the row itself left out of its class (ties are positive; a
    class without other rows loses, and without either the row is negative)."""
    y = F.col(truth) == positive
    sums = df.groupBy(*group).agg(*(F.sum(F.when(c, v)).alias(name) for c, name_ in ((y, "p"), (~y, "n")) for v, name in ((F.col(score), f"_s{name_}"), (F.lit(1.0), f"_c{name_}"))))
    both = df.join(F.broadcast(sums), group)

    def mean(own: Column, s: str, c: str) -> Column:
        n = F.col(c) - own.cast("double")
        return (F.col(s) - F.when(own, F.col(score)).otherwise(0.0)) / F.when(n > 0, n)

    far = lambda m: F.abs(F.col(score) - m)
    p, n = mean(y, "_sp", "_cp"), mean(~y, "_sn", "_cn")
    return both.withColumn("predicted", F.coalesce((far(p) <= far(n)).cast("long"), F.when(p.isNull(), 0).otherwise(1).cast("long"))).drop("_sp", "_cp", "_sn", "_cn")


def metric_at(df: DataFrame, truth: str, positive, score: str, threshold: float, metric: str) -> Column:
    """The metric of one threshold as an aggregate over all rows."""
    y, hit = (F.col(truth) == positive).cast("double"), (F.col(score) > threshold).cast("double")
    return METRICS[metric](F.sum(y * hit), F.sum((1 - y) * hit), F.sum((1 - y) * (1 - hit)), F.sum(y * (1 - hit)))
