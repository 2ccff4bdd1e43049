"""Streams of any length in bounded pieces.

A stream may hold a third of all samples, so nothing may sort it in one task. Five tools:

* ``numbered``: positions in a stream from counts of time ranges, then a rank inside each range;
* ``in_segments``: operators that reach a bounded number of samples back and ahead run on segments of the stream, each
  with the neighbouring samples that it needs (its halo); only a segment's own samples are kept;
* ``last_where``: the last position before a sample at which a condition held, however far back: the last one in each
  segment, carried over segments (one row for each), then inside the segment;
* ``running``: running sums and extremes over a stream, from those of its ranges and then inside each range;
* ``value_ranges``: ranges of any value that follow how its rows are spread, where no time gives them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LENGTH = 1 << 15
#: Rows that a range of values is meant to hold, and parts that one is cut into at most, at each of two levels.
RANGE_ROWS, MOST_PARTS = 1 << 16, 1 << 12
_JOINED = {F.sum: lambda a, b: F.coalesce(a + b, a, b), F.max: F.greatest, F.min: F.least}


def numbered(df: DataFrame, key: list[str], bucket: Column, order: list[str], name: str = "t") -> DataFrame:
    """Adds the position from 0 by order; bucket is a coarse, monotone function of the order that bounds a sort."""
    df = df.withColumn("_b", bucket)
    n = df.groupBy(*key, "_b").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.sum("_n").over(Window.partitionBy(*key).orderBy("_b")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*key, "_b").orderBy(*order)) - 1
    return df.withColumn("_i", inside).join(before, [*key, "_b"]).withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_b", "_i", "_before")


def running(df: DataFrame, key: list[str], bucket: Column, order: list[str | Column], values: dict[str, tuple[Callable, Column]], itself: bool = True) -> DataFrame:
    """Adds, by name, the sum, max or min of a column over the rows of the stream up to each row (without itself, if so
    said); null where there is none. bucket is a coarse, monotone function of the order that bounds a sort; rows with a null
    key or bucket have no place in a stream and are left out."""
    parts = {f"_v{k}": f for k, (f, _) in enumerate(values.values())}
    df = df.withColumns({"_b": bucket} | dict(zip(parts, (c for _, c in values.values()))))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = df.groupBy(*key, "_b").agg(*(f(c).alias(c) for c, f in parts.items())).select(*key, "_b", *(f(c).over(before).alias(f"{c}c") for c, f in parts.items()))
    inside = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    out = df.withColumns({f"{c}i": f(c).over(inside) for c, f in parts.items()}).join(carried, [*key, "_b"])
    found = {name: _JOINED[f](F.col(f"{c}c"), F.col(f"{c}i")) for name, (c, f) in zip(values, parts.items())}
    return out.withColumns(found).drop("_b", *(f"{c}{x}" for c in parts for x in ("", "c", "i")))


def value_ranges(df: DataFrame, key: list[str], value: str, name: str, rows: int | None = None, most: int = MOST_PARTS) -> DataFrame:
    """Adds the number of a range of the value: it never falls where the value grows, and where a key holds more than so many
    rows (RANGE_ROWS by default) its ranges are narrow where rows lie close.

    A key's span is cut into equal parts, as many as its rows call for, and then each part is cut in the same way, so a few
    far values don't leave all others in one part. Only counts and extremes decide, which come out alike in every run. Null
    lies below all values, NaN above, and infinite values in parts of their own. Rows with a null key have no range and are
    left out. The value is numeric; many equal values stay together, so count them first.
    """
    v = F.col(value).cast("double")
    finite = F.abs(v) < float("inf")
    within: list[str] = list(key)
    for part in ("_p0", "_p1"):
        ends = df.groupBy(*within).agg(F.min(F.when(finite, v)).alias("_low"), F.max(F.when(finite, v)).alias("_high"), F.least(F.ceil(F.count("*") / (rows or RANGE_ROWS)), F.lit(most)).alias("_parts"))
        share = F.coalesce(F.try_divide(v / 2 - F.col("_low") / 2, F.col("_high") / 2 - F.col("_low") / 2), F.lit(0.0))
        cell = F.when(v.isNull(), -2).when(v == float("-inf"), -1).when(~finite, most).otherwise(F.least(F.floor(share * F.col("_parts")), F.col("_parts") - 1))
        df = (df.join(ends, within) if within else df.crossJoin(ends)).withColumn(part, cell.cast("long")).drop("_low", "_high", "_parts")
        within.append(part)
    return df.withColumn(name, F.col("_p0") * (most + 3) + F.col("_p1")).drop("_p0", "_p1")


def in_segments(df: DataFrame, key: list[str], index: str, f: Callable[[DataFrame, list[str]], DataFrame], before: int = 0, after: int = 0, length: int = LENGTH) -> DataFrame:
    """f(segments, key) where f looks at most before samples back and after ahead. Each sample goes to its own segment and,
    near a border, to the next as halo: (before + after) / length of the rows are copied."""
    t = F.col(index)
    own = F.floor(t / length)
    spread = F.array_distinct(F.array(F.greatest(F.floor((t - after) / length), F.lit(0).cast("long")), own, F.floor((t + before) / length)))
    pieces = df.withColumn("_segment", F.explode(spread)) if before <= length and after <= length else df.withColumn("_segment", F.explode(F.sequence(F.greatest(F.floor((t - after) / length), F.lit(0).cast("long")), F.floor((t + before) / length))))
    return f(pieces, [*key, "_segment"]).filter(F.col("_segment") == F.floor(F.col(index) / length)).drop("_segment")


def last_where(df: DataFrame, key: list[str], index: str, conditions: dict[str, Column], length: int = LENGTH) -> DataFrame:
    """Adds, by name, the last index before the sample at which the condition held, or null."""
    df = df.withColumns({f"_w{k}": F.when(c, F.col(index)) for k, c in enumerate(conditions.values())}).withColumn("_segment", F.floor(F.col(index) / length))
    cols = [f"_w{k}" for k in range(len(conditions))]
    per = df.groupBy(*key, "_segment").agg(*(F.max(c).alias(c) for c in cols))
    over = Window.partitionBy(*key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*key, "_segment", *(F.max(c).over(over).alias(f"{c}c") for c in cols))
    inside = Window.partitionBy(*key, "_segment").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumns({f"{c}i": F.max(c).over(inside) for c in cols}).join(carried, [*key, "_segment"])
    return out.withColumns({name: F.coalesce(f"_w{k}i", f"_w{k}c") for k, name in enumerate(conditions)}).drop("_segment", *cols, *(f"{c}i" for c in cols), *(f"{c}c" for c in cols))
