"""Random settings of parameters by their priors: one column expression for each kind of parameter.

Draw k of a parameter is a function of (k, seed), so that a search can be repeated and its draws made anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators.generators import normal, uniform

_M = 2654435761


def quantised(x: Column, q: float) -> Column:
    return F.round(x / q) * q


def choice(k: Column, values: list, weights: list[float] | None = None, seed: int = 0) -> Column:
    """One of the values, by weight; equal weights if none are given."""
    weights = weights or [1.0] * len(values)
    u, out, before = uniform(k, _M, seed), F.lit(values[-1]), sum(weights)
    for value, w in reversed(list(zip(values, weights))[:-1]):
        before = sum(weights[: values.index(value) + 1])
        out = F.when(u < before / sum(weights), F.lit(value)).otherwise(out)
    return out


def boolean(k: Column, seed: int = 0) -> Column:
    return uniform(k, _M, seed) < 0.5


def uniform_between(k: Column, low: float, high: float, q: float | None = None, seed: int = 0) -> Column:
    x = low + (high - low) * uniform(k, _M, seed)
    return x if q is None else quantised(x, q)


def log_uniform(k: Column, low: float, high: float, q: float | None = None, seed: int = 0) -> Column:
    x = F.exp(math.log(low) + (math.log(high) - math.log(low)) * uniform(k, _M, seed))
    return x if q is None else quantised(x, q)


def normal_around(k: Column, mean: float, std: float, q: float | None = None, seed: int = 0) -> Column:
    x = mean + std * normal(k, seed)
    return x if q is None else quantised(x, q)


def log_normal(k: Column, shape: float, scale: float, q: float | None = None, seed: int = 0) -> Column:
    x = scale * F.exp(shape * normal(k, seed))
    return x if q is None else quantised(x, q)


def settings(spark: SparkSession, n: int, **parameters: Column) -> DataFrame:
    """n settings: k and a column for each parameter, given as expressions of the column k."""
    return settings_for(spark.range(n).select(F.col("id").alias("k")), "k", **parameters)


def settings_for(df: DataFrame, row: str, **parameters: Column) -> DataFrame:
    """A setting for each row of a table: k (its number) and a column for each parameter, as expressions of k."""
    return df.select(F.col(row).cast("long").alias("k")).select("k", *(x.alias(name) for name, x in parameters.items()))
