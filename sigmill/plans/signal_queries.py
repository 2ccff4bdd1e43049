"""Queries of the preprocessing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import signal as S
from sigmill.plans.inputs import CHANNEL_SQL, SAMPLES, WINDOWS, channels, samples, windows
from sigmill.plans.query import query

STREAM = (["user_id"], ["t"])
WIN = ["user_id", "win"]


def out(df):
    return df.select("user_id", "t", r6("value").alias("value"))


def outw(df):
    return df.select("user_id", "win", "k", r6("value").alias("value"))


def stream_sql(expression: str, where: str = "") -> str:
    return f"WITH {SAMPLES}, x AS (SELECT user_id, t, {expression} AS value FROM samples) SELECT user_id, t, round(value, 6) + 0.0 AS value FROM x {where}"


def window_sql(expression: str, where: str = "") -> str:
    return f"WITH {WINDOWS}, x AS (SELECT user_id, win, k, {expression} AS value FROM windows) SELECT user_id, win, k, round(value, 6) + 0.0 AS value FROM x {where}"


ORD = "(PARTITION BY user_id ORDER BY t)"
PER = "(PARTITION BY user_id, win)"


@query("clip", stream_sql("least(greatest(value, 20.0), 80.0)"))
def clip(spark, d):
    return out(S.clip(samples(spark, d), "value", 20.0, 80.0))


@query("scale", stream_sql("value * 2.5"))
def scale(spark, d):
    return out(S.scale(samples(spark, d), "value", 2.5))


@query("diff2", stream_sql(f"lead(value) OVER {ORD} - value", "WHERE value IS NOT NULL"))
def diff2(spark, d):
    return out(S.diff2(samples(spark, d), "value", *STREAM))


@query("diff5", stream_sql(f"value - 2 * lead(value, 1) OVER {ORD} + 2 * lead(value, 3) OVER {ORD} - lead(value, 4) OVER {ORD}", "WHERE value IS NOT NULL"))
def diff5(spark, d):
    return out(S.diff5(samples(spark, d), "value", *STREAM))


@query("diff2_padded", stream_sql(f"coalesce(lead(value) OVER {ORD} - value, 0.0)"))
def diff2_padded(spark, d):
    return out(S.diff2(samples(spark, d), "value", *STREAM, keep=True))


@query("tkeo", stream_sql(f"lag(value, 1, 0.0) OVER {ORD} * lag(value, 1, 0.0) OVER {ORD} - lag(value, 2, 0.0) OVER {ORD} * value"))
def tkeo(spark, d):
    return out(S.tkeo(samples(spark, d), "value", *STREAM))


_T8 = "(PARTITION BY user_id ORDER BY t ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
_VAR8 = f"greatest((8 * sum(value * value) OVER {_T8} - power(sum(value) OVER {_T8}, 2)) / 64, 0.0)"


@query("moving_variance", stream_sql(_VAR8))
def moving_variance(spark, d):
    return out(S.moving_variance(samples(spark, d), "value", *STREAM, width=8))


@query("moving_zscore", stream_sql(f"CASE WHEN {_VAR8} > 1e-12 THEN (value - sum(value) OVER {_T8} / 8) / sqrt({_VAR8}) ELSE 0.0 END"))
def moving_zscore(spark, d):
    return out(S.moving_zscore(samples(spark, d), "value", *STREAM, width=8))


@query(
    "adaptive_threshold",
    f"""WITH {SAMPLES}, m AS (SELECT user_id, t, CASE WHEN value >= 1.2 * sqrt({_VAR8}) + sum(value) OVER {_T8} / 8 THEN 1 ELSE 0 END AS hit FROM samples),
    n AS (SELECT *, max(CASE WHEN hit = 1 THEN t + 1 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m)
    SELECT user_id, t, CAST(CASE WHEN hit = 1 AND t - coalesce(last, 0) > 2 THEN 1 ELSE 0 END AS INTEGER) AS onset FROM n""",
)
def adaptive_threshold(spark, d):
    return S.adaptive_threshold(samples(spark, d), "value", *STREAM, width=8, factor=1.2, below=2).select("user_id", "t", "onset")


@query("detrend_mean", window_sql(f"value - avg(value) OVER {PER}"))
def detrend_mean(spark, d):
    return outw(S.detrend(windows(spark, d), "value", WIN))


@query("local_standardize", window_sql(f"(value - avg(value) OVER {PER}) / (CASE WHEN stddev_pop(value) OVER {PER} < 1e-15 THEN stddev_pop(value) OVER {PER} + 1 ELSE stddev_pop(value) OVER {PER} END)"))
def local_standardize(spark, d):
    return outw(S.standardize(windows(spark, d), "value", WIN))


@query("max_standardize", window_sql(f"(value - avg(value) OVER {PER}) / CASE WHEN max(value) OVER {PER} - avg(value) OVER {PER} = 0 THEN 1.0 ELSE abs(max(value) OVER {PER} - avg(value) OVER {PER}) END"))
def max_standardize(spark, d):
    return outw(S.max_standardize(windows(spark, d), "value", WIN))


@query(
    "memory_standardize",
    f"""WITH {WINDOWS}, p AS (SELECT user_id, win, avg(value) AS m, var_pop(value) AS v FROM windows GROUP BY user_id, win),
    q AS (SELECT *, sqrt(avg(v) OVER (PARTITION BY user_id ORDER BY win ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) AS sd FROM p)
    SELECT user_id, win, k, round((value - m) / CASE WHEN sd < 1e-15 THEN 1.0 ELSE sd END, 6) + 0.0 AS value FROM windows JOIN q USING (user_id, win)""",
)
def memory_standardize(spark, d):
    return outw(S.memory_standardize(windows(spark, d), "value", ["user_id"], "win", 3))


@query(
    "devariance",
    f"WITH {CHANNEL_SQL}, s AS (SELECT channel, stddev_pop(value) AS sd FROM channels WHERE win % 2 = 0 GROUP BY channel) SELECT win, t, channel, round(CASE WHEN sd > 0 THEN value / sd ELSE value END, 6) + 0.0 AS value FROM channels LEFT JOIN s USING (channel)",
)
def devariance(spark, d):
    return S.devariance(channels(spark, d), "value", ["channel"], F.col("win") % 2 == 0).select("win", "t", "channel", r6("value").alias("value"))


@query("subset_normalize", window_sql(f"value - avg(CASE WHEN k < 4 THEN value END) OVER {PER}"))
def subset_normalize(spark, d):
    return outw(S.subset_normalize(windows(spark, d), "value", WIN, F.col("k") < 4))


@query("subset_standardize", window_sql(f"(value - avg(CASE WHEN k < 4 THEN value END) OVER {PER}) / CASE WHEN coalesce(stddev_pop(CASE WHEN k < 4 THEN value END) OVER {PER}, 0) = 0 THEN 1.0 ELSE stddev_pop(CASE WHEN k < 4 THEN value END) OVER {PER} END"))
def subset_standardize(spark, d):
    return outw(S.subset_normalize(windows(spark, d), "value", WIN, F.col("k") < 4, deviate=True))


@query("euclid_normalize", window_sql(f"CASE WHEN sum(value * value) OVER {PER} = 0 THEN 0.0 ELSE value / sqrt(sum(value * value) OVER {PER}) END"))
def euclid_normalize(spark, d):
    return outw(S.euclid_normalize(windows(spark, d), "value", WIN))


@query("downsample", f"WITH {SAMPLES} SELECT user_id, CAST(t // 4 AS BIGINT) AS t, round(value, 6) + 0.0 AS value FROM samples WHERE t % 4 = 0")
def downsample(spark, d):
    return out(S.downsample(samples(spark, d), "t", 4))


@query("window_hanning", window_sql("value * (0.5 - 0.5 * cos(2 * pi() * k / 15))"))
def window_hanning(spark, d):
    return outw(S.window_function(windows(spark, d), "value", "k", 16))


@query("window_hamming", window_sql("value * (0.54 - 0.46 * cos(2 * pi() * k / 15))"))
def window_hamming(spark, d):
    return outw(S.window_function(windows(spark, d), "value", "k", 16, "hamming"))


def fir_sql(kernel: list[float]) -> str:
    """By a join with the kernel's rows, unlike the sum of lags."""
    rows = ", ".join(f"({k}, {h!r})" for k, h in enumerate(kernel))
    return f"WITH {SAMPLES}, h(j, h) AS (VALUES {rows}) SELECT s.user_id, s.t, round(sum(h.h * coalesce(x.value, 0)), 6) + 0.0 AS value FROM samples s CROSS JOIN h LEFT JOIN samples x ON x.user_id = s.user_id AND x.t = s.t - h.j GROUP BY s.user_id, s.t"


_LOW, _HIGH, _BAND = S.fir_lowpass(31, 0.3), S.fir_highpass(11, 0.2), S.fir_bandpass(21, 0.1, 0.4)


@query("fir_lowpass", fir_sql(_LOW))
def fir_lowpass(spark, d):
    return out(S.fir(samples(spark, d), "value", *STREAM, _LOW))


@query("fir_highpass", fir_sql(_HIGH))
def fir_highpass(spark, d):
    return out(S.fir(samples(spark, d), "value", *STREAM, _HIGH))


@query("fir_bandpass", fir_sql(_BAND))
def fir_bandpass(spark, d):
    return out(S.fir(samples(spark, d), "value", *STREAM, _BAND))


@query(
    "decimation_fir",
    fir_sql(_LOW).replace("SELECT s.user_id, s.t,", "SELECT s.user_id, CAST(s.t // 4 AS BIGINT) AS t,").replace(" GROUP BY", " WHERE s.t % 4 = 0 GROUP BY"),
)
def decimation_fir(spark, d):
    return out(S.downsample(S.fir(samples(spark, d), "value", *STREAM, _LOW), "t", 4))


@query("nan_to_number", f"WITH {SAMPLES}, x AS (SELECT user_id, t, CASE WHEN value > 90 THEN 0.0 ELSE value END AS value FROM samples) SELECT user_id, t, round(value, 6) + 0.0 AS value FROM x")
def nan_to_number(spark, d):
    df = samples(spark, d).withColumn("value", F.when(F.col("value") > 90, F.lit(float("nan"))).otherwise(F.col("value")))
    return out(S.nan_to_number(df, ["value"]))


@query("cast_integer", f"WITH {SAMPLES} SELECT user_id, t, CAST(trunc(value) AS INTEGER) AS value FROM samples")
def cast_integer(spark, d):
    return samples(spark, d).select("user_id", "t", F.col("value").cast("int").alias("value"))


@query("average_reference", f"WITH {CHANNEL_SQL} SELECT win, t, channel, round(value - sum(value) OVER (PARTITION BY win, t) / 5, 4) + 0.0 AS value FROM channels")
def average_reference(spark, d):
    return S.average_reference(channels(spark, d), "value", ["win", "t"], "channel").select("win", "t", "channel", (F.round("value", 4) + 0.0).alias("value"))


@query("hemisphere_difference", "SELECT l_orderkey, l_linenumber, round(l_quantity - l_extendedprice, 4) + 0.0 AS a, round(l_discount - l_tax, 4) + 0.0 AS b FROM lineitem")
def hemisphere_difference(spark, d):
    from sigmill.plans.inputs import table

    df = S.hemisphere_difference(table(spark, d, "lineitem"), [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])
    return df.select("l_orderkey", "l_linenumber", (F.round("l_quantity_minus_l_extendedprice", 4) + 0.0).alias("a"), (F.round("l_discount_minus_l_tax", 4) + 0.0).alias("b"))


_MONTAGE = [("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_quantity"), ("l_discount", "l_tax")]


@query(
    "laplacian_reference",
    f"""WITH {CHANNEL_SQL}, n(channel, neighbour) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in _MONTAGE)})
    SELECT c.win, c.t, c.channel, round(count(*) * min(c.value) - sum(x.value), 6) + 0.0 AS value FROM channels c JOIN n ON c.channel = n.channel JOIN channels x ON x.win = c.win AND x.t = c.t AND x.channel = n.neighbour GROUP BY c.win, c.t, c.channel""",
)
def laplacian_reference(spark, d):
    montage = spark.createDataFrame(_MONTAGE, "channel string, neighbour string")
    return S.laplacian(channels(spark, d), "value", ["win", "t"], "channel", montage).select("win", "t", "channel", r6("value").alias("value"))


@query(
    "constant_channel_cleanup",
    "WITH c AS (SELECT l_orderkey AS win, 'a' AS channel, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, 'b', 1.5 FROM lineitem) SELECT win, channel, value FROM c WHERE channel IN (SELECT channel FROM c GROUP BY channel HAVING min(value) < max(value))",
)
def constant_channel_cleanup(spark, d):
    from sigmill.plans.inputs import table

    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("win"), F.col("l_tax").alias("a"), F.lit(1.5).alias("b")).unpivot(["win"], ["a", "b"], "channel", "value")
    return S.constant_channels(items, "value", "channel").select("win", "channel", "value")


@query("channel_selection", f"WITH {CHANNEL_SQL} SELECT win, t, channel, value FROM channels WHERE channel NOT IN ('l_tax')")
def channel_selection(spark, d):
    return channels(spark, d).filter(~F.col("channel").isin("l_tax")).select("win", "t", "channel", "value")


@query(
    "haar_dwt",
    f"""WITH {WINDOWS}, p AS (SELECT user_id, win, CAST(k // 2 AS BIGINT) AS k, sum(CASE WHEN k % 2 = 0 THEN value END) AS a, sum(CASE WHEN k % 2 = 1 THEN value END) AS b FROM windows GROUP BY user_id, win, k // 2)
    SELECT user_id, win, k, round((a + coalesce(b, a)) / sqrt(2), 6) + 0.0 AS approx, round((a - coalesce(b, a)) / sqrt(2), 6) + 0.0 AS detail FROM p""",
)
def haar_dwt(spark, d):
    return S.haar(windows(spark, d), "value", WIN, "k").select("user_id", "win", "k", r6("approx").alias("approx"), r6("detail").alias("detail"))


@query("generator_sine", f"WITH {SAMPLES} SELECT user_id, t, round(2 * sin(2 * pi() * 5 * t / 100 + 0.5) + 3, 6) + 0.0 AS value FROM samples")
def generator_sine(spark, d):
    df = samples(spark, d)
    x = S.generate(df, "sine", "t", "user_id", frequency=5.0, fs=100.0, phase=0.5, amplitude=2.0) + S.generate(df, "constant", "t", "user_id", value=3.0)
    return df.select("user_id", "t", r6(x).alias("value"))


@query(
    "monotone_time",
    f"""WITH {SAMPLES}, w AS (SELECT user_id, t, CAST((t % 40) * 10 AS DOUBLE) AS a, CAST((t % 40) * 10 + 10 AS DOUBLE) AS b FROM samples),
    j AS (SELECT *, coalesce(sum(jump) OVER {ORD}, 0) AS s FROM (SELECT *, CASE WHEN a < lag(a) OVER {ORD} THEN 1 ELSE 0 END AS jump FROM w)),
    e AS (SELECT user_id, s, coalesce(sum(m) OVER (PARTITION BY user_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS base FROM (SELECT user_id, s, max(b) AS m FROM j GROUP BY user_id, s))
    SELECT user_id, t, a + base AS start_ms, b + base AS end_ms FROM j JOIN e USING (user_id, s)""",
)
def monotone_time(spark, d):
    df = samples(spark, d).select("user_id", "t", ((F.col("t") % 40) * 10).cast("double").alias("start_ms"), ((F.col("t") % 40) * 10 + 10).cast("double").alias("end_ms"))
    return S.monotone_time(df, ["user_id"], ["t"], "start_ms", "end_ms", F.floor(F.col("t") / 4096))
