"""Queries of operators on whole windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import windowed as Y
from sigmill.plans.inputs import WINDOWS, windows
from sigmill.plans.query import query

KEY = ["user_id", "win"]


def _run(spark, d, f):
    arrays = Y.as_arrays(windows(spark, d), KEY, "k", "value")
    return Y.as_samples(Y.each(arrays, f), KEY).select("user_id", "win", "k", r6("value").alias("value"))


@query(
    "dc_removal",
    f"""WITH {WINDOWS}, d AS (SELECT user_id, win, k, value - lag(value, 1, 0.0) OVER (PARTITION BY user_id, win ORDER BY k) AS d FROM windows)
    SELECT a.user_id, a.win, a.k, round(sum(b.d * power(0.951057, a.k - b.k)), 6) + 0.0 AS value FROM d a JOIN d b ON a.user_id = b.user_id AND a.win = b.win AND b.k <= a.k GROUP BY a.user_id, a.win, a.k""",
)
def dc_removal(spark, d):
    return _run(spark, d, Y.dc_removal(0.951057))


@query(
    "fft_bandpass",
    f"""WITH {WINDOWS}, w AS (SELECT * FROM windows WHERE (user_id, win) IN (SELECT (user_id, win) FROM windows GROUP BY user_id, win HAVING count(*) = 16))
    SELECT a.user_id, a.win, a.k, round(sum(b.value * h.g * cos(2 * pi() * h.f * (a.k - b.k) / 16)) / 16, 6) + 0.0 AS value
    FROM w a JOIN w b ON a.user_id = b.user_id AND a.win = b.win, (VALUES (2, 2.0), (3, 2.0), (4, 2.0), (5, 2.0)) h(f, g) GROUP BY a.user_id, a.win, a.k""",
)
def fft_bandpass(spark, d):
    arrays = Y.as_arrays(windows(spark, d), KEY, "k", "value").filter(F.size("x") == 16)
    return Y.as_samples(Y.each(arrays, Y.fft_bandpass(2.0, 5.0, 16.0)), KEY).select("user_id", "win", "k", r6("value").alias("value"))


@query(
    "detrend_linear",
    f"WITH {WINDOWS}, f AS (SELECT *, count(*) OVER p AS n, regr_slope(value, k) OVER p AS s, avg(value) OVER p AS m, avg(k) OVER p AS mk FROM windows WINDOW p AS (PARTITION BY user_id, win)) SELECT user_id, win, k, round(value - m - coalesce(s, 0) * (k - mk), 6) + 0.0 AS value FROM f WHERE n > 1",
)
def detrend_linear(spark, d):
    arrays = Y.as_arrays(windows(spark, d), KEY, "k", "value").filter(F.size("x") > 1)
    return Y.as_samples(Y.each(arrays, Y.detrend_linear), KEY).select("user_id", "win", "k", r6("value").alias("value"))


def _response(b: list[float], a: list[float]) -> list[float]:
    """The first samples of a filter's impulse response, from its spectrum."""
    return [float(x) for x in np.fft.irfft(np.fft.rfft(b, 1 << 14) / np.fft.rfft(a, 1 << 14))[:16]]


@query(
    "iir_lowpass",
    f"""WITH {WINDOWS}, h(j, h) AS (VALUES {", ".join(f"({j}, {x!r})" for j, x in enumerate(_response(*Y.butterworth(2, 0.3))))}),
    f AS (SELECT a.user_id, a.win, a.k, sum(h * b.value) AS value FROM windows a JOIN windows b ON a.user_id = b.user_id AND a.win = b.win JOIN h ON h.j = a.k - b.k GROUP BY a.user_id, a.win, a.k)
    SELECT a.user_id, a.win, a.k, round(sum(h * b.value), 6) + 0.0 AS value FROM f a JOIN f b ON a.user_id = b.user_id AND a.win = b.win JOIN h ON h.j = b.k - a.k GROUP BY a.user_id, a.win, a.k""",
)
def iir_lowpass(spark, d):
    """Butterworth, forward and backward."""
    return _run(spark, d, Y.both_ways(Y.lfilter(*Y.butterworth(2, 0.3))))


@query(
    "fft_resample",
    f"""WITH {WINDOWS}, n AS (SELECT user_id, win, count(*) AS n FROM windows GROUP BY user_id, win), f(f) AS (VALUES (0), (1), (2), (3), (4)), m(m) AS (SELECT unnest(range(8)))
    SELECT w.user_id, w.win, m AS k, round(sum(value * CASE WHEN f = 0 OR 2 * f = least(n, 8) THEN 1 ELSE 2 END * cos(2 * pi() * f * (m / 8.0 - CAST(k AS DOUBLE) / n)) / n), 6) + 0.0 AS value
    FROM windows w JOIN n ON n.user_id = w.user_id AND n.win = w.win JOIN f ON 2 * f <= least(n, 8) CROSS JOIN m GROUP BY w.user_id, w.win, m""",
)
def fft_resample(spark, d):
    return _run(spark, d, Y.fft_resample(8))
