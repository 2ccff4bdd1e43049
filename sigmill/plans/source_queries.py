"""Queries of made-up signals, parameter priors, and conversions between record types."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import convert as V
from sigmill.operators import generators as N
from sigmill.operators import priors as P
from sigmill.plans.inputs import CHANNEL_SQL, FEATURES, SAMPLES, WINDOWS, channels, features, samples, table, windows
from sigmill.plans.query import query


def uniform_sql(k: str, multiplier: int, seed: int) -> str:
    return f"(((({k} + {seed}) % 4294967296) * {multiplier} % 4294967296 + 0.5) / 4294967296.0)"


def normal_sql(k: str, seed: int) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(k, 2654435761, seed)})) * cos(2 * pi() * {uniform_sql(k, 2246822519, seed + 7)}))"


# ---- generators ----


@query(
    "generator_algebra",
    f"""WITH {SAMPLES}, x AS (SELECT user_id, t, t % 4 AS c FROM samples)
    SELECT user_id, t, CAST(0 AS DOUBLE) AS zero, CAST(1 AS DOUBLE) AS one, CAST(t AS DOUBLE) AS time, CAST(c AS DOUBLE) AS channel, CAST(t * 4 + c + 3 AS DOUBLE) AS counter, CAST(t = 2 AS DOUBLE) AS delta, CAST(t = c AS DOUBLE) AS channel_delta,
      round(2 * cos(2 * pi() * 3 * t / 50 + 0.25), 6) + 0.0 AS cosine, round(sin(2 * pi() * 2 * (c + 1) * t / 50), 6) + 0.0 AS channel_sine, round(cos(2 * pi() * 2 * (c + 1) * t / 50), 6) + 0.0 AS channel_cosine,
      round(CAST(CASE WHEN t % 8 < 4 THEN t % 8 ELSE 8 - t % 8 END * 3.0 / 4 AS DOUBLE), 6) AS triangle, CAST(1 + 200 * c + t AS DOUBLE) AS added, round(greatest(sin(2 * pi() * t / 50), 0.5), 6) AS combined FROM x""",
)
def generator_algebra(spark, d):
    t, c = F.col("t"), F.col("t") % 4
    made = {
        "zero": N.zero, "one": N.one, "time": N.time_point, "channel": N.channel, "counter": N.counter(4, 3), "delta": N.delta(-2), "channel_delta": N.delta(by_channel=True),
        "cosine": N.cosine(frequency=3.0, fs=50.0, amplitude=2.0, phase=0.25), "channel_sine": N.sine(frequency=2.0, fs=50.0, by_channel=True), "channel_cosine": N.cosine(frequency=2.0, fs=50.0, by_channel=True),
        "triangle": N.triangle(8, 3.0), "added": N.adder([N.one, N.multiplier([N.constant(200), N.channel]), N.time_point]), "combined": N.combiner([N.sine(fs=50.0), N.constant(0.5)], F.greatest),
    }
    return samples(spark, d).select("user_id", "t", *(r6(g(t, c)).alias(name) for name, g in made.items()))


_TEST_POINTS, _TEST_CHANNELS = 20, 4


@query(
    "test_windows",
    f"""SELECT win, label, t, channel, round({normal_sql(f"((win * {_TEST_POINTS} + t) * {_TEST_CHANNELS} + channel)", 11)} + CASE WHEN label = 'Target' THEN sin(2 * pi() * (win * {_TEST_POINTS} + t) / 1000.0) ELSE 0 END, 5) + 0.0 AS value
    FROM (SELECT c_custkey AS win, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Target' ELSE 'Standard' END AS label FROM customer), (SELECT unnest(range({_TEST_POINTS})) AS t), (SELECT unnest(range({_TEST_CHANNELS})) AS channel)""",
)
def test_windows(spark, d):
    """The two-class source: a window for each customer, a sine in noise for those of one segment and noise for the others."""
    noise = N.gaussian_noise(_TEST_CHANNELS, seed=11)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("win"), F.when(F.col("c_mktsegment") == "BUILDING", "Target").otherwise("Standard").alias("label"))
    w = N.windows_for(customers, "win", "label", {"Target": N.adder([N.sine(fs=1000.0), noise]), "Standard": noise}, _TEST_POINTS, _TEST_CHANNELS)
    return w.select("win", "label", "t", "channel", (F.round("value", 5) + 0.0).alias("value"))


# ---- parameter priors ----

_U = lambda seed: uniform_sql("k", 2654435761, seed)


@query(
    "parameter_priors",
    f"""SELECT k, {_U(1)} < 0.5 AS boolean, CASE WHEN {_U(2)} < 1.0 / 3 THEN 'a' WHEN {_U(2)} < 2.0 / 3 THEN 'b' ELSE 'c' END AS choice, CASE WHEN {_U(3)} < 0.2 THEN 'a' WHEN {_U(3)} < 0.5 THEN 'b' ELSE 'c' END AS weighted,
      round(2 + 3 * {normal_sql("k", 4)}, 5) + 0.0 AS normal, round(-1 + 5 * {_U(5)}, 6) + 0.0 AS uniform, round((2 + 3 * {normal_sql("k", 6)}) / 0.5) * 0.5 + 0.0 AS q_normal, round((-1 + 5 * {_U(7)}) / 0.25) * 0.25 + 0.0 AS q_uniform,
      round(2 * exp(0.5 * {normal_sql("k", 8)}), 5) AS log_normal, round(exp(ln(0.01) + (ln(100) - ln(0.01)) * {_U(9)}), 5) AS log_uniform, round(2 * exp(0.5 * {normal_sql("k", 10)}) / 0.1) * 0.1 AS q_log_normal, round(exp(ln(1) + (ln(100) - ln(1)) * {_U(11)}) / 2) * 2 AS q_log_uniform
    FROM (SELECT o_orderkey AS k FROM orders)""",
)
def parameter_priors(spark, d):
    """Settings of all parameters drawn for each order."""
    k, r5 = F.col("k"), lambda x: F.round(x, 5) + 0.0
    return P.settings_for(
        table(spark, d, "orders"), "o_orderkey", boolean=P.boolean(k, 1), choice=P.choice(k, ["a", "b", "c"], seed=2), weighted=P.choice(k, ["a", "b", "c"], [0.2, 0.3, 0.5], 3), normal=r5(P.normal_around(k, 2.0, 3.0, seed=4)), uniform=r6(P.uniform_between(k, -1.0, 4.0, seed=5)),
        q_normal=P.normal_around(k, 2.0, 3.0, 0.5, 6) + 0.0, q_uniform=P.uniform_between(k, -1.0, 4.0, 0.25, 7) + 0.0, log_normal=r5(P.log_normal(k, 0.5, 2.0, seed=8)), log_uniform=r5(P.log_uniform(k, 0.01, 100.0, seed=9)), q_log_normal=P.log_normal(k, 0.5, 2.0, 0.1, 10), q_log_uniform=P.log_uniform(k, 1.0, 100.0, 2.0, 11),
    )


# ---- conversions ----


@query("features_to_prediction", f"WITH {FEATURES} SELECT id, f, x AS prediction, CASE WHEN x <= 0 THEN 'low' ELSE 'high' END AS label FROM features")
def features_to_prediction(spark, d):
    return V.features_to_prediction(features(spark, d), "x", ("low", "high")).select("id", "f", "prediction", "label")


@query("feature_to_mono_series", f"WITH {FEATURES} SELECT id, CAST(0 AS BIGINT) AS t, 'feature_' || f AS channel, x AS value FROM features")
def feature_to_mono_series(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return V.vector_to_mono_series(e, "x", "feature_").select("id", F.col("t").cast("long").alias("t"), "channel", "value")


@query("mono_series_to_feature", "SELECT l_orderkey AS win, l_linenumber AS line, CAST(f AS INTEGER) AS f, [l_quantity, l_extendedprice, l_discount, l_tax][f + 1] AS x FROM lineitem, (SELECT unnest(range(4)) AS f)")
def mono_series_to_feature(spark, d):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return V.channels_to_vector(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("win"), F.col("l_linenumber").alias("line"), *names), names, "x").select("win", "line", F.posexplode("x").alias("f", "x"))


@query(
    "markers_in_window",
    f"WITH {WINDOWS} SELECT user_id, win, marker, string_agg(CAST(k * 10 AS VARCHAR), ',' ORDER BY k) AS at_ms FROM windows WHERE marker IN ('purchase', 'error') GROUP BY user_id, win, marker",
)
def markers_in_window(spark, d):
    """Markers of each window with their offsets in ms, at 100 samples a second."""
    w = windows(spark, d).filter(F.col("marker").isin("purchase", "error"))
    return V.markers_in_windows(w, ["user_id", "win"], "marker", "k", 100.0).select("user_id", "win", "marker", F.concat_ws(",", F.transform("at_ms", lambda x: x.cast("long").cast("string"))).alias("at_ms"))


@query(
    "rewindow_series",
    f"WITH {WINDOWS}, s AS (SELECT user_id, win * 16 + k AS t, value FROM windows) SELECT user_id, CAST(w AS BIGINT) AS win, CAST(t - w * 8 AS BIGINT) AS k, value FROM s, (SELECT unnest([0, 1]) AS back) b, LATERAL (SELECT t // 8 - back AS w) WHERE t // 8 - back >= 0",
)
def rewindow_series(spark, d):
    """Stored windows are put in line again and cut anew: 16 samples every 8."""
    return V.rewindow(windows(spark, d), ["user_id"], "win", "k", 16, 16, 8).select("user_id", "win", "k", "value")


@query("channel_long", f"WITH {CHANNEL_SQL} SELECT win, count(*) AS n, count(DISTINCT channel) AS channels FROM channels GROUP BY win")
def channel_long(spark, d):
    return channels(spark, d).groupBy("win").agg(F.count("*").alias("n"), F.countDistinct("channel").alias("channels"))


@query(
    "backtransformation",
    f"""WITH {WINDOWS}, h(j, h) AS (VALUES (0, 0.5), (1, 0.25), (2, 0.125)), w AS (SELECT * FROM windows QUALIFY count(*) OVER (PARTITION BY user_id, win) = 16)
    SELECT user_id, win, k + j AS k, round(sum(2 * h * value), 6) + 0.0 AS value FROM w, h WHERE k + j < 16 GROUP BY user_id, win, k + j""",
)
def backtransformation(spark, d):
    """The linear map of a chain (a filter, then a scale and an offset), found by what it does to unit vectors, and applied
    to all whole windows."""
    from sigmill.operators import signal as S

    def chain(df):
        filtered = S.fir(df, "value", ["row"], "t", [0.5, 0.25, 0.125])
        return filtered.withColumn("value", F.col("value") * 2 + 1)

    w = windows(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("user_id", "win"))).filter("n = 16")
    return V.mapped(w, V.backtransformation(spark, chain, 16), ["user_id", "win"], "k", "value").select("user_id", "win", "k", r6("value").alias("value"))
