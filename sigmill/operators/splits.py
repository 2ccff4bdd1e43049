"""Folds that follow a recording: its rows are cut in segments by time, by count or by set flags, and one segment is left out at a time.

A row takes part by the name of its window definition: some definitions train, some test, some do both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators.segments import running


def time_segments(df: DataFrame, stream: list[str], start: str, splits: int) -> DataFrame:
    """Adds segment: equal lengths of time, round((last - first) / splits + 1/2), counted from the stream's first start; an end belongs to its segment."""
    ends = df.groupBy(*stream).agg(F.min(start).alias("_first"), F.max(start).alias("_last"))
    length = F.round((F.col("_last") - F.col("_first")) / splits + 0.5)
    segment = F.greatest(F.ceil((F.col(start) - F.col("_first")) / length) - 1, F.lit(0)).cast("long")
    return df.join(ends, stream).withColumn("segment", segment).drop("_first", "_last")


def running_count(df: DataFrame, stream: list[str], bucket: Column, order: list[str], counted: Column, name: str) -> DataFrame:
    """Adds the number of counted rows up to and with each row. bucket is a coarse, monotone function of the order that
    bounds a sort: counts of buckets are carried over, then rows are counted inside theirs."""
    return running(df, stream, bucket, order, {name: (F.sum, F.coalesce(counted, F.lit(False)).cast("long"))})


def count_segments(df: DataFrame, stream: list[str], bucket: Column, order: list[str], counted: Column, splits: int) -> DataFrame:
    """Adds segment: round(n / splits) counted rows each, the others stay with the counted row before them (with segment 0
    at the start). A single segment left over joins the one before."""
    totals = df.groupBy(*stream).agg(F.sum(F.coalesce(counted, F.lit(False)).cast("long")).alias("_total"))
    each = F.greatest(F.round(F.col("_total") / splits), F.lit(1.0))
    segment = F.greatest(F.floor((F.col("_seen") - 1) / each), F.lit(0))
    left_over = (F.ceil(F.col("_total") / each) == splits + 1) & (segment == splits)
    out = running_count(df, stream, bucket, order, counted, "_seen").join(totals, stream)
    return out.withColumn("segment", F.when(left_over, segment - 1).otherwise(segment).cast("long")).drop("_seen", "_total")


def flag_segments(df: DataFrame, stream: list[str], bucket: Column, order: list[str], new_set: Column) -> DataFrame:
    """Adds segment: one more at each row that begins a new set."""
    return running_count(df, stream, bucket, order, new_set, "segment")


def leave_segment_out(df: DataFrame, stream: list[str], definition: str, train: list[str], test: list[str], reverse: bool = False) -> DataFrame:
    """Adds fold and part: a fold tests on its segment and trains on the stream's others (reverse: the other way round).
    Rows of definitions that are not named for their part are left out of it."""
    last = df.groupBy(*stream).agg(F.max("segment").alias("_last"))
    out = df.join(last, stream).withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    tests = (F.col("segment") != F.col("fold")) if reverse else (F.col("segment") == F.col("fold"))
    return out.filter(F.when(tests, F.col(definition).isin(test)).otherwise(F.col(definition).isin(train))).withColumn("part", F.when(tests, "test").otherwise("train"))
