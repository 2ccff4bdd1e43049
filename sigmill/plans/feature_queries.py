"""Queries of forecasts, shifted correlations and another sampling rate."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import features as X
from sigmill.operators import signal as S
from sigmill.plans.inputs import CHANNELS, RECORDS, SAMPLES, WINDOW, WINDOWS, records, samples, windows
from sigmill.plans.query import query


@query(
    "autoregressive",
    f"""WITH {WINDOWS}, l AS (SELECT user_id, win, value AS a, lag(value, 1) OVER w AS b, lag(value, 2) OVER w AS c, count(*) OVER (PARTITION BY user_id, win) AS n FROM windows WINDOW w AS (PARTITION BY user_id, win ORDER BY k)),
    s AS (SELECT user_id, win, covar_pop(b, b) AS bb, covar_pop(c, c) AS cc, covar_pop(b, c) AS bc, covar_pop(a, b) AS ab, covar_pop(a, c) AS ac FROM l WHERE c IS NOT NULL AND n = {WINDOW} GROUP BY user_id, win)
    SELECT user_id, win, round((ab * cc - ac * bc) / (bb * cc - bc * bc), 6) + 0.0 AS first, round((ac * bb - ab * bc) / (bb * cc - bc * bc), 6) + 0.0 AS second FROM s""",
)
def autoregressive(spark, d):
    """How each sample of a whole window follows from the two before."""
    n = F.count("*").over(Window.partitionBy("user_id", "win"))
    whole = windows(spark, d).withColumn("n", n).filter(F.col("n") == WINDOW)
    out = X.autoregressive(whole, "value", ["user_id", "win"], "k", 2)
    return out.select("user_id", "win", r6(F.col("coefficients")[0]).alias("first"), r6(F.col("coefficients")[1]).alias("second"))


_BB, _CC, _BC, _AB, _AC = (f"covar_pop({x}, {y})" for x, y in ("bb", "cc", "bc", "ab", "ac"))
_SOLVED = f"({_AB} * {_CC} - {_AC} * {_BC}) / nullif({_BB} * {_CC} - {_BC} * {_BC}, 0)", f"({_AC} * {_BB} - {_AB} * {_BC}) / nullif({_BB} * {_CC} - {_BC} * {_BC}, 0)"


@query(
    "moving_average",
    f"""WITH {WINDOWS}, l AS (SELECT user_id, win, k, value AS a, lag(value, 1) OVER w AS b, lag(value, 2) OVER w AS c, count(*) OVER (PARTITION BY user_id, win) AS n FROM windows WINDOW w AS (PARTITION BY user_id, win ORDER BY k)),
    f AS (SELECT user_id, win, {_SOLVED[0]} AS p, {_SOLVED[1]} AS q FROM l WHERE c IS NOT NULL AND n = {WINDOW} GROUP BY user_id, win),
    e AS (SELECT user_id, win, a, b, lag(a - p * b - q * c) OVER (PARTITION BY user_id, win ORDER BY k) AS c FROM l JOIN f USING (user_id, win))
    SELECT user_id, win, round({_SOLVED[0]}, 4) + 0.0 AS sample, round({_SOLVED[1]}, 4) + 0.0 AS shock FROM e WHERE c IS NOT NULL GROUP BY user_id, win""",
)
def moving_average(spark, d):
    """How each sample of a whole window follows from the one before and from what the one before had that wasn't foreseen."""
    n = F.count("*").over(Window.partitionBy("user_id", "win"))
    whole = windows(spark, d).withColumn("n", n).filter(F.col("n") == WINDOW)
    out = X.moving_average(whole, "value", ["user_id", "win"], "k", 1, 1, 2)
    r4 = lambda c: F.round(c, 4) + 0.0
    return out.select("user_id", "win", r4(F.col("coefficients")[0]).alias("sample"), r4(F.col("coefficients")[1]).alias("shock"))


_POINTS, _SEGMENTS, _SHIFT = 7, 3, 1
_BORDERS = [k * _POINTS // (_SEGMENTS + 1) for k in range(_SEGMENTS + 2)]
_PARTS = ", ".join(f"({k}, {_BORDERS[k]}, {_BORDERS[k + 2]})" for k in range(_SEGMENTS))
_WHOLE = f"""{RECORDS}, v AS (SELECT *, t - 1 AS i, count(*) OVER (PARTITION BY win) AS n FROM records), s AS (SELECT v.*, p.k AS seg, i - p.a AS pos FROM v JOIN (VALUES {_PARTS}) p(k, a, b) ON i >= p.a AND i < p.b WHERE n = {_POINTS})"""


def _pair(a: str, b: str) -> str:
    r = f"CASE WHEN stddev_pop(x.{a}) * stddev_pop(y.{b}) > 1e-12 THEN covar_pop(x.{a}, y.{b}) / (stddev_pop(x.{a}) * stddev_pop(y.{b})) END"
    return f"SELECT x.win, CAST(x.seg AS INTEGER) AS first, CAST(y.seg AS INTEGER) AS second, '{a}:{b}' AS pair, round({r}, 6) + 0.0 AS r FROM s x JOIN s y ON x.win = y.win AND x.pos = y.pos AND y.seg <= x.seg + {_SHIFT} GROUP BY x.win, x.seg, y.seg"


@query("pearson_shifts", f"WITH {_WHOLE} " + " UNION ALL ".join(_pair(a, b) for i, a in enumerate(CHANNELS) for b in CHANNELS[i + 1 :]))
def pearson_shifts(spark, d):
    """Channel pairs of windows of seven samples, compared between overlapping segments."""
    n = F.count("*").over(Window.partitionBy("win"))
    whole = records(spark, d).withColumns({"n": n, "i": F.col("t") - 1}).filter(F.col("n") == _POINTS)
    return X.pearson_shifts(whole, ["win"], "i", CHANNELS, _POINTS, _SEGMENTS, _SHIFT).select("win", "first", "second", "pair", r6("r").alias("r"))


_TAPS = S.fir_lowpass(33, 0.8 * 60.0 / 100.0)


@query(
    "subsample",
    f"""WITH {SAMPLES}, u AS (SELECT user_id, t * 3 + k AS t, CASE WHEN k = 0 THEN value ELSE value + (after - value) * k / 3.0::DOUBLE END AS x
      FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY t) AS after FROM samples), (VALUES (0), (1), (2)) s(k) WHERE k = 0 OR after IS NOT NULL),
    h AS (SELECT * FROM (VALUES {", ".join(f"({k}, {h!r}::DOUBLE)" for k, h in enumerate(_TAPS))}) h(lag, h))
    SELECT a.user_id, a.t // 5 AS t, round(sum(h * b.x), 6) + 0.0 AS value FROM u a JOIN h ON a.t >= lag JOIN u b ON b.user_id = a.user_id AND b.t = a.t - lag WHERE a.t % 5 = 0 GROUP BY a.user_id, a.t""",
)
def subsample(spark, d):
    """From 100 to 60 Hz: two samples between each two, a low pass, and every fifth."""
    return S.subsample(samples(spark, d), "value", ["user_id"], "t", 100.0, 60.0).select("user_id", "t", r6("value").alias("value"))
