"""Queries of learners that take rows one at a time; in SQL each is a recursion over a key's rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.plans.inputs import CHANNELS, table
from sigmill.plans.query import query
from sigmill.plans.stream_queries import _events, shared_folder
from sigmill.streaming import online as O

MARGINS = {"margin": O.Margin(0.5, 2.0, weights=(1.0, 2.0)), "squared": O.Margin(0.5, 2.0, squared=True), "one_class": O.one_class(0.5, 3.0), "one_class_squared": O.one_class(0.5, 3.0, True)}
BALLS = {"pa0": O.Ball(0.2, 0), "pa1": O.Ball(0.2, 1, 0.05), "pa2": O.Ball(0.2, 2, 0.5), "fitted": O.Ball(0.3, 1, 0.05, fit_radius=True)}

_ROWS = "e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, value / 100 AS x0, (event_id % 10) / 10.0::DOUBLE AS x1, event_type = 'purchase' AS pos FROM events)"


def _margin_sql(name: str, r: O.Margin) -> str:
    squared = "+ 1 / (2 * most)" if r.squared else ""
    bound = (lambda gap: f"{gap} / room") if r.squared else (lambda gap: f"least({gap} / room, most)")
    low, high = f"CASE WHEN pos THEN {r.complexity * r.weights[1]} ELSE {r.complexity * r.weights[0]} END", r.complexity * r.outer_factor
    return f"""{name}(user_id, n, event_id, w0, w1, b, f) AS (
    SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, {r.start_offset}::DOUBLE, NULL::DOUBLE FROM e
    UNION ALL
    SELECT user_id, n, event_id, w0 + step * x0, w1 + step * x1, b + {r.offset} * step, f FROM (
      SELECT *, CASE WHEN NOT learns THEN 0.0 WHEN m < 1 AND room > 0 THEN side * {bound('(1 - m)')} WHEN m > {r.outer} AND room > 0 THEN -side * {bound(f'(m - {r.outer})')} ELSE 0.0 END AS step FROM (
        SELECT *, x0 * x0 + x1 * x1 + {r.offset} {squared} AS room FROM (
          SELECT *, side * f AS m, CASE WHEN side * f < 1 THEN {low} ELSE {high} END AS most FROM (
            SELECT e.user_id, e.n, e.event_id, e.pos, e.x0, e.x1, s.w0, s.w1, s.b, CASE WHEN e.pos THEN 1.0 ELSE -1.0 END AS side, {'e.pos' if r.start_offset else 'true'} AS learns, s.w0 * e.x0 + s.w1 * e.x1 + s.b AS f
            FROM {name} s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)))))"""


def _ball_sql(name: str, r: O.Ball) -> str:
    by = ("loss", f"least({r.complexity}, loss)", f"loss / (1 + 1 / (2 * {r.complexity}))")[r.version]
    return f"""{name}(user_id, n, event_id, radius, seen, c0, c1, f) AS (
    SELECT DISTINCT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), {0.0 if r.fit_radius else r.radius}::DOUBLE, false, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM e
    UNION ALL
    SELECT user_id, n, event_id, CASE WHEN NOT moved THEN radius WHEN more * (1 - step) > 0 THEN sqrt({r.radius ** 2} - (more * (1 - step)) ** 2) ELSE {r.radius} END, seen OR pos,
      CASE WHEN pos AND NOT seen THEN x0 WHEN moved THEN c0 + step * (x0 - c0) ELSE c0 END, CASE WHEN pos AND NOT seen THEN x1 WHEN moved THEN c1 + step * (x1 - c1) ELSE c1 END, CASE WHEN seen THEN away - radius ELSE -radius END
    FROM (SELECT *, seen AND pos AND loss > 0 AS moved, CASE WHEN loss > 0 THEN {by} / (loss + {r.radius}) ELSE 0.0 END AS step FROM (
      SELECT *, sqrt(away * away + more * more) - {r.radius} AS loss FROM (
        SELECT e.user_id, e.n, e.event_id, e.pos, e.x0, e.x1, s.radius, s.seen, s.c0, s.c1, sqrt((s.c0 - e.x0) ** 2 + (s.c1 - e.x1) ** 2) AS away, CASE WHEN {r.radius} > s.radius THEN sqrt({r.radius ** 2} - s.radius ** 2) ELSE 0.0 END AS more
        FROM {name} s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))))"""


def _sql(parts: dict[str, str]) -> str:
    first, *others = parts
    joins = "".join(f" JOIN {x} ON {x}.event_id = {first}.event_id" for x in others)
    return f"WITH RECURSIVE {_ROWS}, " + ", ".join(parts.values()) + f" SELECT {first}.user_id, {first}.event_id, " + ", ".join(f"round({x}.f, 6) + 0.0 AS {x}" for x in parts) + f" FROM {first}{joins} WHERE {first}.event_id IS NOT NULL"


def _vectors(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", F.array(F.col("value") / 100, (F.col("event_id") % 10) / 10.0).alias("x"), F.when(F.col("event_type") == "purchase", 1.0).otherwise(-1.0).alias("y"))


def _scores(df: DataFrame, rules) -> DataFrame:
    return df.select("user_id", "event_id", *(r6(F.col(r)[0]).alias(r) for r in rules))


@query("online_margins", _sql({k: _margin_sql(k, r) for k, r in MARGINS.items()}))
def online_margins(spark, d):
    """Relative margin perceptrons for each user, of two classes and of one, with linear and squared loss."""
    return _scores(O.fold(_vectors(table(spark, d, "events")), "user_id", "event_id", "x", "y", MARGINS), MARGINS)


@query("online_balls", _sql({k: _ball_sql(k, r) for k, r in BALLS.items()}))
def online_balls(spark, d):
    """Passive-aggressive descriptions of one class for each user: the three ways to take a loss, and a fitted radius."""
    return _scores(O.fold(_vectors(table(spark, d, "events")), "user_id", "event_id", "x", "y", BALLS), BALLS)


_LIVE = {"margin": MARGINS["margin"], "pa2": BALLS["pa2"]}


@query("online_stream", _sql({"margin": _margin_sql("margin", _LIVE["margin"]), "pa2": _ball_sql("pa2", _LIVE["pa2"])}))
def online_stream(spark, d):
    """The same learners on a live stream, with their states in the state store."""
    return _scores(_run(spark, O.fold_stream(_vectors(_events(spark, d)), "user_id", "event_id", "x", "y", _LIVE)), _LIVE)


def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    root = f"{shared_folder(spark)}/online-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    with O.state_store(spark):
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


SAMPLES = 4


def order_windows(spark: SparkSession, d: str) -> DataFrame:
    """stream (the supplier of the first line), win, x (SAMPLES x channels, flat by sample) and y of the orders with enough
    lines."""
    scale = dict(zip(CHANNELS, (50.0, 1e5, 0.1, 0.1)))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    lines = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).alias("t"), "l_returnflag", "l_suppkey", F.array(*(F.col(c).cast("double") / scale[c] - 0.5 for c in CHANNELS)).alias("v")).filter(F.col("t") <= SAMPLES)
    whole = lines.groupBy("l_orderkey").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s["v"])).alias("x"), F.max(F.when((F.col("t") == 1) & (F.col("l_returnflag") == "A"), 1.0).otherwise(0.0)).alias("y"), F.max(F.when(F.col("t") == 1, F.col("l_suppkey"))).alias("stream"))
    return whole.filter(F.size("x") == SAMPLES * len(CHANNELS)).select("stream", F.col("l_orderkey").alias("win"), "x", "y")


XDAWN = {"plain": O.AdaptiveXdawn(len(CHANNELS), 2), "forgetting": O.AdaptiveXdawn(len(CHANNELS), 2, 0.999, 0.999, burn_in=20), "ridge": O.AdaptiveXdawn(len(CHANNELS), 2, ridge=100.0), "exact": O.AdaptiveXdawn(len(CHANNELS), 2, exact=True)}


@query("adaptive_xdawn")
def adaptive_xdawn(spark, d):
    """Spatial filters that follow each of several live streams of windows, as they are after each window."""
    path = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    w = order_windows(spark, d)
    w.write.parquet(path)
    out = _run(spark, O.fold_stream(spark.readStream.schema(w.schema).parquet(path), "stream", "win", "x", "y", XDAWN))
    return out.select("stream", "win", *(F.transform(k, lambda v: F.round(v, 6)).alias(k) for k in XDAWN))
