"""Features of windows, in long form: one row for each window, channel and feature."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmill.functions.expr import correlation, total


def statistics(df: DataFrame, key: list[str], value: str, orders: int = 4) -> DataFrame:
    """Raw and central moments, deviation, root of the sum of squares, median, min and max.

    The second raw moment is the sum of squares, the others are means.
    """
    x = F.col(value)
    m = F.avg(value).over(Window.partitionBy(*key))
    df = df.withColumn("_c", x - m)
    raw = [F.avg(value).alias("raw_1"), F.sum(x * x).alias("raw_2"), *(F.avg(F.pow(x, k)).alias(f"raw_{k}") for k in range(3, orders + 1))]
    central = [F.avg(F.pow("_c", F.lit(k))).alias(f"central_{k}") for k in range(2, orders + 1)]
    return df.groupBy(*key).agg(*raw, *central, F.stddev_pop(value).alias("std"), F.sqrt(F.sum(x * x)).alias("quadratic_mean"), F.percentile(value, 0.5).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"))


def pearson(df: DataFrame, record: list[str], index: str, channels: list[str], segment: int) -> DataFrame:
    """Correlation of all channel pairs in segments of a window (wide channels)."""
    seg = df.withColumn("segment", F.floor(F.col(index) / segment))
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i + 1 :]]
    out = seg.groupBy(*record, "segment").agg(F.count("*").alias("n"), *(correlation(a, b).alias(f"{a}:{b}") for a, b in pairs))
    return out.unpivot([*record, "segment", "n"], [f"{a}:{b}" for a, b in pairs], "pair", "r")


def class_average_correlation(df: DataFrame, record: list[str], index: str, channel: str, value: str, label: str, train) -> DataFrame:
    """Correlation of each window with the mean training window of each class, by channel."""
    mean = df.filter(train).groupBy(label, channel, index).agg(F.avg(value).alias("_m")).withColumnRenamed(label, "class")
    return df.join(F.broadcast(mean), [channel, index]).groupBy(*record, channel, "class").agg(F.count("*").alias("n"), correlation(value, "_m").alias("r"))


def straight_line(df: DataFrame, key: list[str], index: str, value: str, size: int) -> DataFrame:
    """Least-squares line in segments of size samples: slope, and offset at the segment's start."""
    seg = df.withColumn("segment", F.floor(F.col(index) / size)).withColumn("_x", (F.col(index) % size).cast("double"))
    return seg.groupBy(*key, "segment").agg(F.count("*").alias("n"), F.regr_slope(value, "_x").alias("slope"), F.regr_intercept(value, "_x").alias("offset"))


def time_domain(df: DataFrame, key: list[str], channel: str, index: str, value: str, points: list[int], fs: float) -> DataFrame:
    """The samples at some points as named features."""
    return df.filter(F.col(index).isin(points)).select(*key, F.format_string("TD_%s_%.3fsec", F.col(channel).cast("string"), (F.col(index) / fs).cast("double")).alias("feature"), F.col(value).alias("x"))


def time_differences(df: DataFrame, key: list[str], index: str, value: str, points: list[int]) -> DataFrame:
    """x[b] - x[a] for each two points a < b: points are few, so they become columns of one row for each key."""
    wide = df.filter(F.col(index).isin(points)).groupBy(*key).agg(*(F.max(F.when(F.col(index) == p, F.col(value))).alias(f"p{p}") for p in points))
    pairs = [(a, b) for a in points for b in points if a < b]
    return wide.select(*key, *((F.col(f"p{b}") - F.col(f"p{a}")).alias(f"d{a}_{b}") for a, b in pairs)).unpivot(key, [f"d{a}_{b}" for a, b in pairs], "feature", "x")


def spectrum(df: DataFrame, key: list[str], index: str, value: str, size: int) -> DataFrame:
    """Power of each frequency bin of windows of size samples, as sums of products with sines and cosines."""
    def part(bin_: int, f) -> F.Column:
        turn = 2 * math.pi * bin_ / size
        return F.sum(F.col(value) * f(F.col(index) * turn))

    bins = range(size // 2 + 1)
    sums = df.groupBy(*key).agg(F.count("*").alias("n"), *(part(b, F.cos).alias(f"c{b}") for b in bins), *(part(b, F.sin).alias(f"s{b}") for b in bins))
    power = [(F.col(f"c{b}") * F.col(f"c{b}") + F.col(f"s{b}") * F.col(f"s{b}")).alias(f"p{b}") for b in bins]
    return sums.filter(F.col("n") == size).select(*key, *power)


def bands(df: DataFrame, key: list[str], index: str, value: str, size: int, limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Power of bands of bins [low, high), in decibels."""
    power = spectrum(df, key, index, value, size)
    return power.select(*key, *((10 * F.log10(F.greatest(total([F.col(f"p{b}") for b in range(*lim)]), F.lit(1e-12)))).alias(name) for name, lim in limits.items()))


def stft(df: DataFrame, value: str, key: list[str], index: str, frame: int, hop: int, fs: float = 1.0, band: tuple[float, float] | None = None) -> DataFrame:
    """Power in decibels of Hann frames: key, frame, bin, frequency, time (of the frame's middle), power.

    A frame is ``frame`` (even) consecutive samples of a series, the next one begins ``hop`` later; incomplete ones are left
    out. A sample goes to the frames it lies in (frame / hop of them), and each (frame, bin) is two sums of products, so
    neither frames nor series are put together. Powers are one-sided densities; null where there is none."""
    if frame % 2 or frame < 2 or not 0 < hop <= frame:
        raise ValueError("a frame is an even number of samples, and hops are at most as long")
    low, high = band or (0.0, fs / 2)
    bins = [b for b in range(frame // 2 + 1) if low <= b * fs / frame <= high]
    t = F.col(index)
    first = F.greatest(F.ceil((t - frame + 1) / hop), F.lit(0).cast("long"))
    at = df.withColumn("frame", F.explode(F.sequence(first, F.floor(t / hop)))).withColumn("_k", t - F.col("frame") * hop).filter(F.col("_k") < frame)
    x = F.col(value) * (0.5 - 0.5 * F.cos(2 * math.pi * F.col("_k") / (frame - 1)))
    turn = lambda b: 2 * math.pi * b * F.col("_k") / frame
    sums = at.groupBy(*key, "frame").agg(F.count(value).alias("_n"), *(F.sum(x * f(turn(b))).alias(f"_{c}{b}") for b in bins for c, f in (("c", F.cos), ("s", F.sin))))
    weight = sum((0.5 - 0.5 * math.cos(2 * math.pi * k / (frame - 1))) ** 2 for k in range(frame)) * fs
    power = lambda b: (F.col(f"_c{b}") ** 2 + F.col(f"_s{b}") ** 2) * ((1.0 if b in (0, frame // 2) else 2.0) / weight)
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("bin"), F.lit(b * fs / frame).alias("frequency"), power(b).alias("p")) for b in bins)))
    rows = sums.filter(F.col("_n") == frame).select(*key, "frame", ((F.col("frame") * hop + frame / 2) / fs).alias("time"), each.alias("_b"))
    return rows.select(*key, "frame", "time", "_b.bin", "_b.frequency", F.when(F.col("_b.p") > 0, 10 * F.log10("_b.p")).alias("power"))


def pearson_shifts(df: DataFrame, record: list[str], index: str, channels: list[str], points: int, segments: int, shift: int = 0) -> DataFrame:
    """Correlations of channel pairs between segments of windows of points samples (wide channels): the segments overlap by
    half, and that of the first channel (first) meets those of the second up to shift segments later (second). Unequal
    segments are compared as far as the shorter one goes. record, first, second, pair, r."""
    if not 0 <= shift < segments:
        raise ValueError("the shift is smaller than the number of segments")
    border = [k * points // (segments + 1) for k in range(segments + 2)]
    ranges = [(k, border[k], border[k + 2]) for k in range(segments)]
    parts = F.filter(F.array(*(F.struct(F.lit(k).alias("s"), (F.col(index) - a).alias("k"), ((F.col(index) >= a) & (F.col(index) < b)).alias("in")) for k, a, b in ranges)), lambda x: x["in"])
    each = df.select(*record, *channels, F.explode(parts).alias("_p")).select(*record, *channels, "_p.s", "_p.k")
    a = each.select(*record, "k", F.col("s").alias("first"), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(channels)))
    b = each.select(*record, "k", F.col("s").alias("second"), *(F.col(c).alias(f"_b{i}") for i, c in enumerate(channels)))
    pairs = [(i, j) for i in range(len(channels)) for j in range(i + 1, len(channels))]
    names = {f"{channels[i]}:{channels[j]}": correlation(f"_a{i}", f"_b{j}") for i, j in pairs}
    out = a.join(b, [*record, "k"]).filter(F.col("second") <= F.col("first") + shift).groupBy(*record, "first", "second").agg(*(r.alias(n) for n, r in names.items()))
    return out.unpivot([*record, "first", "second"], list(names), "pair", "r")


def autoregressive(df: DataFrame, value: str, key: list[str], index: str, order: int) -> DataFrame:
    """key, coefficients: of the order samples before in the least-squares forecast (with a constant) of each window's
    samples; null where the window is too short or too regular to tell. Each window is sums of products of its lags."""
    w = Window.partitionBy(*key).orderBy(index)
    return _regressed(df.select(*key, *(F.lag(F.col(value).cast("double"), k).over(w).alias(f"_{k}") for k in range(order + 1))), key, order)


def moving_average(df: DataFrame, value: str, key: list[str], index: str, order: int, shocks: int, long: int | None = None) -> DataFrame:
    """key, coefficients: of the order samples and then of the shocks before, in the forecast of each window's samples by
    both (an ARMA fit in two regressions). Shocks are what a forecast from ``long`` samples (order + shocks + 2 by default)
    doesn't foresee. Null where the window is too short or too regular for either regression."""
    long = order + shocks + 2 if long is None else long
    w = Window.partitionBy(*key).orderBy(index)
    x = df.select(*key, index, F.col(value).cast("double").alias("_x")).withColumns({f"_l{k}": F.lag("_x", k).over(w) for k in range(1, max(order, long) + 1)})
    foreseen = total([F.col(f"_l{k}") * F.col("coefficients")[k - 1] for k in range(1, long + 1)])
    first = autoregressive(df, value, key, index, long)
    both = x.join(first, key).withColumn("_e", F.col("_x") - foreseen)  # without the constant: the second regression has one
    lags = [F.col("_x"), *(F.col(f"_l{k}") for k in range(1, order + 1)), *(F.lag("_e", k).over(w) for k in range(1, shocks + 1))]
    found = _regressed(both.select(*key, *(c.alias(f"_{k}") for k, c in enumerate(lags))), key, order + shocks)
    return first.select(*key).join(found, key, "left")


def _regressed(df: DataFrame, key: list[str], order: int) -> DataFrame:
    """key, coefficients: of the columns _1 to _order in the least-squares line for _0, over the rows that have all."""
    n = order + 1
    whole = df.dropna(subset=[f"_{k}" for k in range(n)])
    sums = whole.groupBy(*key).agg(F.count("*").alias("_n"), F.array(*(F.sum(f"_{i}") for i in range(n))).alias("_s"), F.array(*(F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i in range(n) for j in range(n))).alias("_q"))
    schema = T.StructType([*(df.schema[k] for k in key), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = lambda c: np.asarray(b.column(c).flatten(), float)
            count, s, q = np.asarray(b.column("_n"), float), flat("_s").reshape(-1, n), flat("_q").reshape(-1, n, n)
            c = q - s[:, :, None] * s[:, None, :] / count[:, None, None]
            scale = np.maximum(np.abs(q).max((1, 2)), 1e-300)
            out = [np.linalg.solve(m[1:, 1:], m[1:, 0]).tolist() if k > order and np.linalg.eigvalsh(m[1:, 1:] / z).min() > 1e-12 else None for m, k, z in zip(c, count, scale)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), pa.array(out, pa.list_(pa.float64()))], names=[*key, "coefficients"])

    return sums.mapInArrow(solve, schema)
