"""Conversions between record types: windows, vectors, series of one sample, predictions, streams and linear maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def features_to_prediction(df: DataFrame, value: str, labels: tuple[str, str]) -> DataFrame:
    """Each feature as a prediction: its value is the score, and the first label goes to values up to 0."""
    return df.withColumn("prediction", F.col(value)).withColumn("label", F.when(F.col(value) <= 0, labels[0]).otherwise(labels[1]))


def vector_to_mono_series(df: DataFrame, vector: str, prefix: str) -> DataFrame:
    """A vector as a series of one sample: a channel for each entry, at time 0."""
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, F.posexplode(vector).alias("_p", "value")).select(*rest, F.lit(0).alias("t"), F.concat(F.lit(prefix), F.col("_p").cast("string")).alias("channel"), "value")


def channels_to_vector(df: DataFrame, channels: list[str], vector: str) -> DataFrame:
    """A series of one sample, channels in columns, as a vector in the channels' order."""
    return df.select(*(c for c in df.columns if c not in channels), F.array(*(F.col(c).cast("double") for c in channels)).alias(vector))


def markers_in_windows(df: DataFrame, key: list[str], marker: str, index: str, rate: float) -> DataFrame:
    """For each window and marker the offsets in ms, in order. A window is short, so its list is."""
    return df.filter(F.col(marker).isNotNull()).groupBy(*key, marker).agg(F.sort_array(F.collect_list((F.col(index) * 1000.0 / rate).cast("double"))).alias("at_ms"))


def rewindow(df: DataFrame, key: list[str], win: str, index: str, length: int, size: int, step: int) -> DataFrame:
    """Windows of ``length`` samples put in line and cut again, ``size`` samples every ``step``: each sample goes to the
    windows that hold it. The last windows may be short."""
    t = F.col(win) * length + F.col(index)
    last = F.floor(t / step)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((t - size + 1) / step))
    out = df.withColumn("_t", t).withColumn(win, F.explode(F.sequence(first, last)))
    return out.withColumn(index, (F.col("_t") - F.col(win) * step).cast("long")).drop("_t")


def backtransformation(spark: SparkSession, chain: Callable[[DataFrame], DataFrame], points: int) -> DataFrame:
    """i, t, weight: what sample i of a window contributes to the chain's output at t.

    The chain reads and gives (row, t, value). It sees one window for each unit vector and one of zeros, whose output is
    the affine map's offset and is taken away.
    """
    n = F.lit(points)
    flat = spark.range((points + 1) * points).select(F.floor(F.col("id") / n).alias("row"), F.pmod("id", n).alias("t"))
    out = chain(flat.withColumn("value", (F.col("row") == F.col("t")).cast("double"))).select("row", "t", "value")
    zero = out.filter(F.col("row") == points).select("t", F.col("value").alias("_zero"))
    return out.filter(F.col("row") < points).join(zero, "t").select(F.col("row").alias("i"), "t", (F.col("value") - F.col("_zero")).alias("weight"))


def mapped(df: DataFrame, weights: DataFrame, window: list[str], index: str, value: str) -> DataFrame:
    """window, index, value: windows under a linear map (i, t, weight), as sums of weighted samples. Samples meet the
    weights by equality of the index; weights of 0 are left out, so a short filter copies a sample few times."""
    w = weights.filter("weight <> 0").withColumnsRenamed({"i": "_i", "t": "_t", "weight": "_w"})
    out = df.join(w, F.col(index) == F.col("_i")).groupBy(*window, "_t").agg(F.sum(F.col(value) * F.col("_w")).alias(value))
    return out.withColumnRenamed("_t", index)
