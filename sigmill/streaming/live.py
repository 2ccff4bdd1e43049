"""The live side with Structured Streaming: windows of a sample stream, stateful filters, predictions, online confusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_means(stream: DataFrame, key: list[str], time: str, value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean and deviation of sliding event-time windows; rows later than the watermark allows are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(*key, w.alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.select(*key, F.col("w.start").alias("start"), "n", "mean", "sd")


def sessions(stream: DataFrame, key: list[str], time: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Trials: runs of events with no longer gap."""
    out = stream.withWatermark(time, late).groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dc_removal(stream: DataFrame, key: str, order: str, value: str, alpha: float = 0.95) -> DataFrame:
    """y[t] = x[t] - x[t-1] + alpha y[t-1] for each key, with the last x and y as state across batches.

    Rows of a key within a batch are put in order; the source delivers batches in order.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        x0, y0 = state.get if state.exists else (0.0, 0.0)
        df = pd.concat(list(frames)).sort_values(order)
        out = []
        for x in df[value]:
            y0 = x - x0 + alpha * y0
            x0 = x
            out.append(y0)
        state.update((x0, y0))
        yield pd.DataFrame({key: k[0], order: df[order].to_numpy(), value: out})

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double", "x double, y double", "append", GroupStateTimeout.NoTimeout)


def predict(stream: DataFrame, model: Callable[[DataFrame], DataFrame], table: str, checkpoint: str):
    """Applies a fitted model to each batch and appends the predictions to a table, once for each batch number."""

    def write(batch: DataFrame, number: int) -> None:
        model(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def online_confusion(predictions: DataFrame, responses: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Predictions matched with a response of the same key in time: a stream-stream join that watermarks bound.

    predictions(key, p_time, predicted), responses(key, r_time, truth).
    """
    p = predictions.withWatermark("p_time", late).alias("p")
    r = responses.withWatermark("r_time", late).alias("r")
    near = (F.col(f"p.{key}") == F.col(f"r.{key}")) & (F.col("r.r_time") >= F.col("p.p_time")) & (F.col("r.r_time") <= F.col("p.p_time") + F.expr(f"INTERVAL {within}"))
    return p.join(r, near).select(F.col(f"p.{key}").alias(key), "p_time", "r_time", "predicted", "truth")


def class_sums(df: DataFrame, key: str, kind: str, value: str, positive, negative) -> DataFrame:
    """key, kind, s, n: sums of two kinds of rows, of a table or (in complete or update mode) of a stream."""
    return df.filter(F.col(kind).isin(positive, negative)).groupBy(key, kind).agg(F.sum(value).alias("s"), F.count(value).alias("n"))


def midpoints(sums: DataFrame, key: str, kind: str, positive, negative) -> DataFrame:
    """The threshold classifier that such sums give: halfway between the means of both kinds, and the side (1 or -1) on
    which the positive kind lies; for keys that have both."""
    mean = lambda k: F.max(F.when(F.col(kind) == k, F.try_divide("s", "n")))
    out = sums.groupBy(key).agg(mean(positive).alias("_p"), mean(negative).alias("_q")).filter("_p IS NOT NULL AND _q IS NOT NULL")
    return out.select(key, ((F.col("_p") + F.col("_q")) / 2).alias("threshold"), F.when(F.col("_p") >= F.col("_q"), 1).otherwise(-1).alias("side"))
