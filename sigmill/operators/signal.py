"""Preprocessing of sampled signals in long form: one row for each sample of each channel.

``key`` names the columns that make one signal (a window and a channel, or a stream), ``order`` those that order its
samples. Operators on streams look a bounded number of samples back or ahead; they run on segments of the stream with a
halo (see ``segments``), so a stream of any length is many tasks. What needs all samples of a key at once is for
windows, whose length their definition bounds. Consecutive steps on one (key, order) share a shuffle and a sort.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sigmill.functions.expr import col, total
from sigmill.operators.segments import LENGTH, in_segments, running


def over(key: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def trailing(key: list[str], order: list[str], width: int) -> WindowSpec:
    return over(key, order).rowsBetween(-(width - 1), 0)


def clip(df: DataFrame, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    x = F.col(value)
    x = x if high is None else F.least(x, F.lit(high))
    return df.withColumn(value, x if low is None else F.greatest(x, F.lit(low)))


def scale(df: DataFrame, value: str, factor: float) -> DataFrame:
    return df.withColumn(value, F.col(value) * factor)


def diff2(df: DataFrame, value: str, key: list[str], order: list[str], keep: bool = False, length: int = LENGTH) -> DataFrame:
    """x[t+1] - x[t]; the last sample is dropped, or 0 with keep."""

    def run(df: DataFrame, key: list[str]) -> DataFrame:
        d = F.lead(value, 1).over(over(key, order)) - F.col(value)
        out = df.withColumn(value, F.coalesce(d, F.lit(0.0)) if keep else d)
        return out if keep else out.filter(F.col(value).isNotNull())

    return in_segments(df, key, order[0], run, 0, 1, length)


def diff5(df: DataFrame, value: str, key: list[str], order: list[str], keep: bool = False, length: int = LENGTH) -> DataFrame:
    """x[t] - 2 x[t+1] + 2 x[t+3] - x[t+4]; the last four samples are dropped, or 0 with keep."""

    def run(df: DataFrame, key: list[str]) -> DataFrame:
        at = lambda k: F.lead(value, k).over(over(key, order))
        d = F.col(value) - 2 * at(1) + 2 * at(3) - at(4)
        out = df.withColumn(value, F.coalesce(d, F.lit(0.0)) if keep else d)
        return out if keep else out.filter(F.col(value).isNotNull())

    return in_segments(df, key, order[0], run, 0, 4, length)


def tkeo(df: DataFrame, value: str, key: list[str], order: list[str], length: int = LENGTH) -> DataFrame:
    """Teager-Kaiser energy x[t-1]^2 - x[t-2] x[t], with zeros before the first sample."""

    def run(df: DataFrame, key: list[str]) -> DataFrame:
        at = lambda k: F.lag(value, k, 0.0).over(over(key, order))
        return df.withColumn(value, at(1) * at(1) - at(2) * F.col(value))

    return in_segments(df, key, order[0], run, 2, 0, length)


def moving_moments(value: str, key: list[str], order: list[str], width: int) -> tuple[Column, Column]:
    """Mean and population variance of the last width samples, with zeros before the first."""
    w = trailing(key, order, width)
    s, q = F.sum(value).over(w), F.sum(F.col(value) * F.col(value)).over(w)
    return s / width, F.greatest((width * q - s * s) / (width * width), F.lit(0.0))


def moving_variance(df: DataFrame, value: str, key: list[str], order: list[str], width: int, length: int = LENGTH) -> DataFrame:

    def run(df: DataFrame, key: list[str]) -> DataFrame:
        return df.withColumn(value, moving_moments(value, key, order, width)[1])

    return in_segments(df, key, order[0], run, width - 1, 0, length)


def moving_zscore(df: DataFrame, value: str, key: list[str], order: list[str], width: int, length: int = LENGTH) -> DataFrame:

    def run(df: DataFrame, key: list[str]) -> DataFrame:
        mean, var = moving_moments(value, key, order, width)
        return df.withColumn(value, F.when(var > 1e-12, (F.col(value) - mean) / F.sqrt(var)).otherwise(F.lit(0.0)))

    return in_segments(df, key, order[0], run, width - 1, 0, length)


def adaptive_threshold(df: DataFrame, value: str, key: list[str], order: list[str], width: int, factor: float, below: int, length: int = LENGTH) -> DataFrame:
    """1 at a sample that reaches factor * sd + mean of the last width samples after more than below samples under it.

    order[0] is the sample's position in its stream, which counts as under the threshold before it begins.
    """

    def run(df: DataFrame, key: list[str]) -> DataFrame:
        mean, var = moving_moments(value, key, order, width)
        hit = (F.col(value) >= factor * F.sqrt(var) + mean).cast("int")
        recent = F.coalesce(F.max("_hit").over(over(key, order).rowsBetween(-below - 1, -1)), F.lit(0))
        onset = (F.col("_hit") == 1) & (recent == 0) & (F.col(order[0]) > below)
        return df.withColumn("_hit", hit).withColumn("onset", onset.cast("int")).drop("_hit")

    return in_segments(df, key, order[0], run, width + below, 0, length)


def detrend(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """Subtracts the signal's mean."""
    return df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*key)))


def standardize(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """z-score of each signal with the population deviation; one below 1e-15 is raised by 1."""
    w = Window.partitionBy(*key)
    sd = F.stddev_pop(value).over(w)
    return df.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.when(sd < 1e-15, sd + 1).otherwise(sd))


def max_standardize(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    """(x - mean) / abs(max(x - mean)): the largest centred value, not the largest magnitude."""
    w = Window.partitionBy(*key)
    centred = F.col(value) - F.avg(value).over(w)
    top = F.abs(F.max(value).over(w) - F.avg(value).over(w))
    return df.withColumn(value, centred / F.when(top == 0, F.lit(1.0)).otherwise(top))


def memory_standardize(df: DataFrame, value: str, stream: list[str], window: str, order_n: int) -> DataFrame:
    """Centres each window by its own mean, and divides by the root of the mean variance of it and the order_n windows before."""
    per = df.groupBy(*stream, window).agg(F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"))
    w = Window.partitionBy(*stream).orderBy(window).rowsBetween(-order_n, 0)
    per = per.withColumn("_sd", F.sqrt(F.avg("_var").over(w)))
    sd = F.when(F.col("_sd") < 1e-15, F.lit(1.0)).otherwise(F.col("_sd"))
    return df.join(per, [*stream, window]).withColumn(value, (F.col(value) - F.col("_mean")) / sd).drop("_mean", "_var", "_sd")


def devariance(df: DataFrame, value: str, channel: list[str], train: Column) -> DataFrame:
    """Multiplies each channel by 1 / sd over its training samples."""
    sd = df.filter(train).groupBy(*channel).agg(F.stddev_pop(value).alias("_sd"))
    return df.join(F.broadcast(sd), channel, "left").withColumn(value, F.when(F.col("_sd") > 0, F.col(value) / F.col("_sd")).otherwise(F.col(value))).drop("_sd")


def subset_normalize(df: DataFrame, value: str, key: list[str], subset: Column, deviate: bool = False) -> DataFrame:
    """Subtracts the mean (and divides by the deviation) of the samples for which subset holds."""
    w = Window.partitionBy(*key)
    some = F.when(subset, F.col(value))
    x = F.col(value) - F.avg(some).over(w)
    if deviate:
        sd = F.stddev_pop(some).over(w)
        x = x / F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd)
    return df.withColumn(value, x)


def euclid_normalize(df: DataFrame, value: str, key: list[str]) -> DataFrame:
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*key)))
    return df.withColumn(value, F.when(norm == 0, F.lit(0.0)).otherwise(F.col(value) / norm))


def downsample(df: DataFrame, index: str, k: int) -> DataFrame:
    """Every k-th sample, renumbered."""
    return df.filter(F.col(index) % k == 0).withColumn(index, F.floor(F.col(index) / k))


def decimation_steps(factor: int) -> list[int]:
    """A factor above 10 is split in two, the larger part first, as evenly as its divisors allow (a prime stays whole)."""
    if factor <= 10:
        return [factor]
    first = next(k for k in range(math.isqrt(factor - 1) + 1, factor + 1) if factor % k == 0)
    return [first, factor // first] if first < factor else [factor]


def decimate(df: DataFrame, value: str, key: list[str], order: list[str], factor: int, taps: int = 31, share: float = 0.8) -> DataFrame:
    """In each step a low-pass filter at a share of the new Nyquist frequency, then every k-th sample: later steps filter fewer samples."""
    for k in decimation_steps(factor):
        df = downsample(fir(df, value, key, order, fir_lowpass(taps, share / k)), order[0], k)
    return df


def window_function(df: DataFrame, value: str, index: str, size: int, kind: str = "hanning") -> DataFrame:
    """Multiplies by a window of size samples; one of a single sample is 1."""
    if size == 1:
        return df
    turn = 2 * math.pi * F.col(index) / (size - 1)
    shape = {"hanning": 0.5 - 0.5 * F.cos(turn), "hamming": 0.54 - 0.46 * F.cos(turn), "blackman": 0.42 - 0.5 * F.cos(turn) + 0.08 * F.cos(2 * turn)}[kind]
    return df.withColumn(value, F.col(value) * shape)


def fir_lowpass(taps: int, cutoff: float, window: str = "hamming") -> list[float]:
    """Windowed-sinc kernel for a cut-off as a share of the Nyquist frequency, with gain 1 at frequency 0."""
    n = np.arange(taps) - (taps - 1) / 2
    turn = 2 * np.pi * np.arange(taps) / (taps - 1)
    shape = {"hamming": 0.54 - 0.46 * np.cos(turn), "hanning": 0.5 - 0.5 * np.cos(turn), "boxcar": np.ones(taps)}[window]
    h = cutoff * np.sinc(cutoff * n) * shape
    return [float(x) for x in h / h.sum()]


def fir_highpass(taps: int, cutoff: float, window: str = "hamming") -> list[float]:
    """Spectral inversion of the low-pass kernel; taps is odd."""
    h = [-x for x in fir_lowpass(taps, cutoff, window)]
    h[taps // 2] += 1
    return h


def fir_bandpass(taps: int, low: float, high: float, window: str = "hamming") -> list[float]:
    return [a - b for a, b in zip(fir_lowpass(taps, high, window), fir_lowpass(taps, low, window))]


def fir(df: DataFrame, value: str, key: list[str], order: list[str], kernel: list[float], length: int = LENGTH) -> DataFrame:
    """Causal convolution with zero initial state, as a sum of lags: one sort, no join."""

    def run(df: DataFrame, key: list[str]) -> DataFrame:
        w = over(key, order)
        return df.withColumn(value, total([h * F.lag(value, k, 0.0).over(w) for k, h in enumerate(kernel)]))

    return in_segments(df, key, order[0], run, len(kernel) - 1, 0, length)


def nan_to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.isnan(c), F.lit(0.0)).otherwise(F.col(c)) for c in columns})


def average_reference(df: DataFrame, value: str, record: list[str], channel: str, selected: Column | None = None) -> DataFrame:
    """Adds -sum(selected) / (number of channels + 1) to each channel of a record."""
    w = Window.partitionBy(*record)
    s = F.sum(F.when(selected, F.col(value)) if selected is not None else F.col(value)).over(w)
    return df.withColumn(value, F.col(value) - s / (F.count(channel).over(w) + 1))


def hemisphere_difference(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """left - right for wide channel columns."""
    return df.withColumns({f"{a}_minus_{b}": F.col(a) - F.col(b) for a, b in pairs})


def laplacian(df: DataFrame, value: str, record: list[str], channel: str, neighbours: DataFrame) -> DataFrame:
    """k x - sum of the k neighbours; neighbours(channel, neighbour) is the (small) montage, channels without any are removed."""
    near = df.select(*record, F.col(channel).alias("neighbour"), F.col(value).alias("_near")).join(F.broadcast(neighbours), "neighbour")
    sums = near.groupBy(*record, channel).agg(F.count("*").alias("_k"), F.sum("_near").alias("_sum"))
    return df.join(sums, [*record, channel]).withColumn(value, F.col("_k") * F.col(value) - F.col("_sum")).drop("_k", "_sum")


def constant_channels(df: DataFrame, value: str, channel: str) -> DataFrame:
    """The channels that vary."""
    varying = df.groupBy(channel).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).filter("_a < _b").select(channel)
    return df.join(F.broadcast(varying), channel, "left_semi")


def haar(df: DataFrame, value: str, key: list[str], index: str) -> DataFrame:
    """One level of the Haar transform of each pair of samples: approx and detail at half the rate."""
    two = df.withColumn("_half", F.floor(F.col(index) / 2)).groupBy(*key, "_half").agg(
        F.sum(F.when(F.col(index) % 2 == 0, F.col(value))).alias("_a"), F.sum(F.when(F.col(index) % 2 == 1, F.col(value))).alias("_b")
    )
    b = F.coalesce(F.col("_b"), F.col("_a"))
    return two.select(*key, F.col("_half").alias(index), ((F.col("_a") + b) / math.sqrt(2)).alias("approx"), ((F.col("_a") - b) / math.sqrt(2)).alias("detail"))


def monotone_time(df: DataFrame, key: list[str], order: list[str], start: str, end: str, bucket: Column, sets: int = LENGTH) -> DataFrame:
    """Where a start jumps back, it and all later windows are moved by the largest end so far.

    bucket is a coarse, monotone function of the order that bounds a sort; what lies between two jumps is a set, and ends
    are added up over ranges of that many sets, so a stream is never in one task whole. Rows with a null key or bucket are
    left out.
    """
    last = running(df, key, bucket, order, {"_before": (F.max, F.struct(*order, F.col(start).alias("_start")))}, itself=False)
    jump = F.coalesce((F.col(start) < F.col("_before._start")).cast("long"), F.lit(0).cast("long"))
    before = running(last.withColumn("_jump", jump), key, bucket, order, {"_set": (F.sum, F.col("_jump"))}).drop("_before", "_jump")
    ends = before.groupBy(*key, "_set").agg(F.max(end).alias("_end"))
    base = running(ends, key, F.floor(F.col("_set") / sets), ["_set"], {"_base": (F.sum, F.col("_end"))}, itself=False)
    moved = before.join(base.select(*key, "_set", F.coalesce("_base", F.lit(0.0)).alias("_base")), [*key, "_set"])
    return moved.withColumn(start, F.col(start) + F.col("_base")).withColumn(end, F.col(end) + F.col("_base")).drop("_set", "_base")


def generate(df: DataFrame, kind: str, t: str | Column, channel: str | Column, **p: float) -> Column:
    """A generator expression of (time, channel): sine, cosine, triangle, delta, constant, channel or time."""
    t, channel = col(t), col(channel)
    turn = 2 * math.pi * p.get("frequency", 1.0) * t / p.get("fs", 1.0) + p.get("phase", 0.0)
    return {
        "sine": p.get("amplitude", 1.0) * F.sin(turn),
        "cosine": p.get("amplitude", 1.0) * F.cos(turn),
        "triangle": F.when(t % p.get("width", 2.0) < p.get("width", 2.0) / 2, t % p.get("width", 2.0)).otherwise(p.get("width", 2.0) - t % p.get("width", 2.0)) * p.get("height", 1.0) / (p.get("width", 2.0) / 2),
        "delta": F.when(t == p.get("k", 0), F.lit(1.0)).otherwise(F.lit(0.0)),
        "constant": F.lit(float(p.get("value", 0.0))),
        "channel": channel.cast("double"),
        "time": t.cast("double"),
    }[kind]


def interpolate(df: DataFrame, value: str, key: list[str], index: str, factor: int, length: int = LENGTH) -> DataFrame:
    """factor - 1 samples on the line between each two: key, index (anew), value."""
    if factor == 1:
        return df.select(*key, index, value)

    def run(df: DataFrame, key: list[str]) -> DataFrame:
        steps = F.when(F.col("_after").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
        return df.withColumn("_after", F.lead(value).over(Window.partitionBy(*key).orderBy(index))).withColumn("_k", F.explode(steps))

    out = in_segments(df.select(*key, index, value), key, index, run, after=1, length=length)
    between = F.when(F.col("_k") == 0, F.col(value)).otherwise(F.col(value) + (F.col("_after") - F.col(value)) * F.col("_k") / factor)
    return out.select(*key, (F.col(index) * factor + F.col("_k")).alias(index), between.alias(value))


def subsample(df: DataFrame, value: str, key: list[str], index: str, source: float, target: float, taps: int = 33) -> DataFrame:
    """Another sampling rate by way of the common multiple of both (in hundredths of a Hertz): samples are added on lines
    between neighbours, a low pass at 0.4 of the target rate (as a share of the source's) follows, then every so many stay."""
    a, b = round(source * 100), round(target * 100)
    common = math.gcd(a, b)
    up, down = b // common, a // common
    more = interpolate(df, value, key, index, up)
    return downsample(fir(more, value, key, [index], fir_lowpass(taps, min(1.0, 0.8 * target / source))), index, down)
