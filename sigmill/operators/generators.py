"""Made-up signals as column expressions of (time, channel), and their sums and products.

A generator is a function of two columns, so that an algebra of them stays one expression inside the JVM. Noise is a
function of the position, not of the task that makes it: a lost task makes the same values again.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.functions.expr import times_mod32

Generator = Callable[[Column, Column], Column]

_M1, _M2, _MIX, _TWO32 = 2654435761, 2246822519, 73244475, 1 << 32


def constant(value: float) -> Generator:
    return lambda t, c: F.lit(float(value))


zero, one = constant(0.0), constant(1.0)


def time_point(t: Column, c: Column) -> Column:
    return t.cast("double")


def channel(t: Column, c: Column) -> Column:
    return c.cast("double")


def counter(channels: int, start: int = 0) -> Generator:
    """Counts values in the order (time, channel)."""
    return lambda t, c: (t * channels + c + start).cast("double")


def sine(frequency: float = 1.0, fs: float = 1.0, amplitude: float = 1.0, phase: float = 0.0, by_channel: bool = False, wave: Callable[[Column], Column] = F.sin) -> Generator:
    """amplitude * sin(2 pi f t / fs + phase); by_channel: f is multiplied by the channel's number from 1."""
    return lambda t, c: amplitude * wave(2 * math.pi * frequency * (c + 1 if by_channel else F.lit(1)) * t / fs + phase)


def cosine(**p) -> Generator:
    return sine(wave=F.cos, **p)


def delta(k: int = 0, by_channel: bool = False) -> Generator:
    """1 at time -k (by_channel: at the channel's number), else 0."""
    return lambda t, c: F.when(t == (c if by_channel else F.lit(-k)), 1.0).otherwise(0.0)


def triangle(width: float, height: float) -> Generator:
    """Rises over half of each width and falls over the other half."""

    def value(t: Column, c: Column) -> Column:
        at, half = t % width, width / 2
        return F.when(at < half, at).otherwise(width - at) * height / half

    return value


def uniform(k: Column, multiplier: int, seed: int) -> Column:
    """A number in (0, 1) that (k, seed) fixes: a multiplicative hash mod 2**32, in plain integer arithmetic."""
    return (times_mod32(k.cast("long") + seed, multiplier) + 0.5) / float(_TWO32)


def mixed(k: Column) -> Column:
    """A number below 2**32 of which every bit depends on every bit of k mod 2**32: shifts and products that any SQL has."""
    x = F.pmod(k.cast("long"), F.lit(_TWO32))
    for _ in range(2):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(_MIX), F.lit(_TWO32))
    return x.bitwiseXOR(F.shiftright(x, 16))


def normal(k: Column, seed: int = 0) -> Column:
    """A standard normal number that (k, seed) fixes, from two uniform ones."""
    return F.sqrt(-2 * F.log(uniform(k, _M1, seed))) * F.cos(2 * math.pi * uniform(k, _M2, seed + 7))


def gaussian_noise(channels: int, mean: float = 0.0, std: float = 1.0, seed: int = 0) -> Generator:
    return lambda t, c: mean + std * normal(t * channels + c, seed)


def combiner(generators: list[Generator], how: Callable[[Column, Column], Column]) -> Generator:
    """Any binary operation over the values of several generators."""
    return lambda t, c: reduce(how, (g(t, c) for g in generators))


def adder(generators: list[Generator]) -> Generator:
    return combiner(generators, lambda a, b: a + b)


def multiplier(generators: list[Generator]) -> Generator:
    return combiner(generators, lambda a, b: a * b)


def generated_windows(spark: SparkSession, kinds: list[tuple[str, int, Generator]], points: int, channels: int) -> DataFrame:
    """win, label, t, channel, value: for each (label, number of windows, generator) so many windows, numbered in order.

    The generator's time runs on from window to window.
    """
    label, value, before = F.lit(None).cast("string"), F.lit(None).cast("double"), 0
    win, t, c = F.col("win"), F.col("t"), F.col("channel")
    for name, n, g in kinds:
        here = (win >= before) & (win < before + n)
        label, value, before = F.when(here, name).otherwise(label), F.when(here, g(win * points + t, c)).otherwise(value), before + n
    flat = spark.range(before * points * channels)
    at = flat.select(F.floor(F.col("id") / (points * channels)).alias("win"), F.pmod(F.floor(F.col("id") / channels), F.lit(points)).alias("t"), F.pmod("id", F.lit(channels)).alias("channel"))
    return at.withColumn("label", label).withColumn("value", value)


def windows_for(df: DataFrame, window: str, label: str, kinds: dict[str, Generator], points: int, channels: int) -> DataFrame:
    """window, label, t, channel, value: one window for each row of a table, made by the generator of the row's label, so
    there are as many windows as the table has rows. The generator's time runs on with the window's number; a label without
    a generator gives no window. Rows are dealt out first: a short table is one task, and what it is spelled out to isn't short."""
    t, c = F.col("t"), F.col("channel")
    value = F.lit(None).cast("double")
    for name, g in kinds.items():
        value = F.when(F.col(label) == name, g(F.col(window) * points + t, c)).otherwise(value)
    dealt = df.filter(F.col(label).isin(list(kinds))).select(F.col(window).cast("long").alias(window), label).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), window)
    flat = dealt.select(window, label, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points * channels - 1).cast("long"))).alias("_i"))
    return flat.select(window, label, F.floor(F.col("_i") / channels).alias("t"), F.pmod("_i", F.lit(channels)).alias("channel")).withColumn("value", value)
