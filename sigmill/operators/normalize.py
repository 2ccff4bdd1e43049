"""Normalisation of feature vectors in long form (id, f, x): statistics by feature from training rows, or norms by vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.operators.segments import running, value_ranges


def apply(df: DataFrame, feature: str, value: str, parameters: DataFrame) -> DataFrame:
    """(x - shift) * factor by feature; what isn't finite becomes 0. parameters: a row for each feature."""
    y = (F.col(value) - F.col("shift")) * F.col("factor")
    return df.join(F.broadcast(parameters), feature).withColumn(value, F.when(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")), 0.0).otherwise(y)).drop("shift", "factor")


def outlier(train: DataFrame, feature: str, value: str, percent: float = 10.0, exact: bool = True) -> DataFrame:
    """Maps the percentiles percent / 2 and 100 - percent / 2 to 0 and 1.

    Exact ones are found by ``quantiles``, which never has a feature's values in one task; with exact off they are
    approximate, in one aggregate of bounded memory.
    """
    ends = [percent / 200, 1 - percent / 200]
    if exact:
        found = quantiles(train, feature, value, ends).select(feature, *(F.col("quantiles")[k].alias(f"_{k}") for k in range(2)))
    else:
        found = train.groupBy(feature).agg(*(F.percentile_approx(value, q, 10_000).alias(f"_{k}") for k, q in enumerate(ends)))
    low, high = F.col("_0"), F.col("_1")
    return found.select(feature, low.alias("shift"), F.when(high == low, 1.0).otherwise(1 / (high - low)).alias("factor"))


def quantiles(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """key, quantiles: the exact ones of each key, on the line between the two values next to a share's place.

    Values are counted, the counts added up over ranges of values and then inside a range, and those at the wanted places
    are taken. Null values don't count; a key without others has null quantiles, and rows with a null key are left out.
    """
    some = df.select(key, F.col(value).cast("double").alias("_x"))
    total = some.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("_x").alias("_total"))
    n = some.filter(F.col("_x").isNotNull()).groupBy(key, "_x").agg(F.count("*").alias("_m"))
    run = running(value_ranges(n, [key], "_x", "_r"), [key], F.col("_r"), ["_x"], {"_upto": (F.sum, F.col("_m"))}).join(total, key)
    place = [(F.col("_total") - 1) * q for q in shares]
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_x")))
    found = run.groupBy(key).agg(*(at(f(p)).alias(f"_{c}{j}") for j, p in enumerate(place) for c, f in (("a", F.floor), ("b", F.ceil))))
    between = [F.when(F.col(f"_a{j}") == F.col(f"_b{j}"), F.col(f"_a{j}")).otherwise((F.ceil(p) - p) * F.col(f"_a{j}") + (p - F.floor(p)) * F.col(f"_b{j}")) for j, p in enumerate(place)]
    return total.join(found, key, "left").select(key, F.array(*between).alias("quantiles"))


def gaussian(train: DataFrame, feature: str, value: str) -> DataFrame:
    sd = F.stddev_pop(value)
    return train.groupBy(feature).agg(F.avg(value).alias("shift"), F.when(sd < 1e-9, 1.0).otherwise(1 / sd).alias("factor"))


def histogram(train: DataFrame, feature: str, value: str, bins: int = 3) -> DataFrame:
    """Mean and deviation of the values in the fullest of the bins between min and max, edges included; the first of equals."""
    limits = train.groupBy(feature).agg(F.min(value).alias("_low"), ((F.max(value) - F.min(value)) / bins).alias("_step"))
    df = train.join(F.broadcast(limits), feature).withColumn("_bin", F.when(F.col("_step") == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_low")) / F.col("_step")), F.lit(bins - 1))).cast("int"))
    n = df.groupBy(feature, "_bin").agg(F.count("*").alias("_n"))
    best = n.groupBy(feature).agg(F.max(F.struct(F.col("_n"), (-F.col("_bin")).alias("b")))["b"].alias("_best")).withColumn("_best", -F.col("_best"))
    inside = df.join(F.broadcast(best), feature).filter(F.col(value).between(F.col("_low") + F.col("_best") * F.col("_step"), F.col("_low") + (F.col("_best") + 1) * F.col("_step")))
    return gaussian(inside, feature, value)


def by_norm(df: DataFrame, vector: str, value: str, order: float | str = 2) -> DataFrame:
    """Divides each vector by its norm of the given order; a zero vector stays."""
    w = Window.partitionBy(vector)
    x = F.abs(F.col(value))
    norm: Column = {
        "inf": lambda: F.max(x).over(w),
        "-inf": lambda: F.min(x).over(w),
        0: lambda: F.sum((x > 0).cast("double")).over(w),
        1: lambda: F.sum(x).over(w),
        2: lambda: F.sqrt(F.sum(x * x).over(w)),
    }.get(order, lambda: F.pow(F.sum(F.pow(x, F.lit(float(order)))).over(w), F.lit(1 / float(order)) if not isinstance(order, str) else F.lit(1.0)))()
    return df.withColumn(value, F.when(norm == 0, F.col(value)).otherwise(F.col(value) / norm))
