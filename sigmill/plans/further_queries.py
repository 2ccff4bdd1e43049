"""Queries of folds along a recording, of losses, of decimation in steps and of wavelets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sigmill.functions.expr import r6, spread_hash
from sigmill.operators import metrics as M
from sigmill.operators import signal as S
from sigmill.operators import splits as P
from sigmill.operators import windowed as Y
from sigmill.plans.inputs import PREDICTIONS, SAMPLES, WINDOWS, predictions, samples, table, windows
from sigmill.plans.query import query

STREAM = ["user_id"]
_TRAIN, _TEST = ["purchase", "click"], ["purchase", "view"]


def _folds_sql(segments: str, reverse: bool = False) -> str:
    tests = "s.segment <> f.fold" if reverse else "s.segment = f.fold"
    named = lambda x: ", ".join(f"'{v}'" for v in x)
    return f"""WITH {SAMPLES}, s AS ({segments}), f AS (SELECT user_id, unnest(range(max(segment) + 1)) AS fold FROM s GROUP BY user_id)
    SELECT s.user_id, s.t, s.segment, f.fold, CASE WHEN {tests} THEN 'test' ELSE 'train' END AS part FROM s JOIN f USING (user_id)
    WHERE CASE WHEN {tests} THEN s.marker IN ({named(_TEST)}) ELSE s.marker IN ({named(_TRAIN)}) END"""


def _range():
    return F.floor(F.col("t") / 4096)


def _folds(segments, reverse=False):
    return P.leave_segment_out(segments, STREAM, "marker", _TRAIN, _TEST, reverse).select("user_id", "t", "segment", "fold", "part")


@query(
    "transfer_split_time",
    _folds_sql("SELECT *, CAST(greatest(ceil((t - a) / round(CAST(b - a AS DOUBLE) / 4 + 0.5)) - 1, 0) AS BIGINT) AS segment FROM (SELECT *, min(t) OVER (PARTITION BY user_id) AS a, max(t) OVER (PARTITION BY user_id) AS b FROM samples)"),
)
def transfer_split_time(spark, d):
    return _folds(P.time_segments(samples(spark, d), STREAM, "t", 4))


def _count_sql(order: str) -> str:
    return f"""SELECT *, CASE WHEN ceil(n / e) = 5 AND g = 4 THEN g - 1 ELSE g END AS segment FROM (SELECT *, CAST(greatest(floor((c - 1) / e), 0) AS BIGINT) AS g FROM (SELECT *, greatest(round(CAST(n AS DOUBLE) / 4), 1.0) AS e FROM
        (SELECT *, sum(CASE WHEN marker = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) AS n, sum(CASE WHEN marker = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY {order}) AS c FROM samples)))"""


@query("transfer_split_count", _folds_sql(_count_sql("t")))
def transfer_split_count(spark, d):
    return _folds(P.count_segments(samples(spark, d), STREAM, _range(), ["t"], F.col("marker") == "purchase", 4))


@query("transfer_split_random", _folds_sql(_count_sql("(t * 2654435761) % 4294967296, t")))
def transfer_split_random(spark, d):
    """The split by count of a recording in random order, which a hash of the time gives; rows of one time stay in line."""
    mixed = spread_hash("t")
    return _folds(P.count_segments(samples(spark, d), STREAM, F.floor(mixed / (1 << 24)), [mixed, "t"], F.col("marker") == "purchase", 4))


@query("transfer_split_flags", _folds_sql("SELECT *, CAST(sum(CASE WHEN t > 0 AND t % 50 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS BIGINT) AS segment FROM samples", True))
def transfer_split_flags(spark, d):
    """A new set at each 50th sample; the folds train on one set and test on the others."""
    return _folds(P.flag_segments(samples(spark, d), STREAM, _range(), ["t"], (F.col("t") > 0) & (F.col("t") % 50 == 0)), True)


_DISTANCES = {"SVM": "greatest(1 - m, 0)", "plain": "abs(m - 1)", "RMM": "CASE WHEN m > 1.2 THEN m - 1.2 WHEN m > 1 THEN 0 ELSE 1 - m END"}
_TERMS = {f"{cut}L{p}_{k}": f"power({f'least({x}, 1.1)' if cut else x}, {p})" for k, x in _DISTANCES.items() for cut in ("", "restr_") for p in (1, 2)}


@query(
    "margin_losses",
    f"WITH {PREDICTIONS}, x AS (SELECT fold, truth, CASE WHEN truth = 1 THEN score ELSE -score END AS m FROM predictions) SELECT fold, "
    + ", ".join(f'round(avg({x}), 6) + 0.0 AS "{k}", round((coalesce(avg({x}) FILTER (truth = 1), 0) + coalesce(avg({x}) FILTER (truth = 0), 0)) / 2, 6) + 0.0 AS "balanced_{k}"' for k, x in _TERMS.items())
    + " FROM x GROUP BY fold",
)
def margin_losses(spark, d):
    out = M.margin_losses(predictions(spark, d), ["fold"], "truth", "score", 1, 1.1, 1.2)
    return out.select("fold", *(r6(c).alias(c) for c in out.columns if c != "fold"))


_REGRESSION = {"MSE": "avg(power(p - a, 2))", "RMSE": "sqrt(avg(power(p - a, 2)))", "MAE": "avg(abs(p - a))", "RSE": "avg(power(p - a, 2)) / var_pop(a)", "RAE": "avg(abs(p - a)) / avg(abs(a - mean))", "correlation": "corr(a, p)", "RRSE": "sqrt(avg(power(p - a, 2)) / var_pop(a))"}


@query(
    "regression_vectors",
    f"""WITH x AS (SELECT l_returnflag AS flag, unnest([l_extendedprice, l_quantity, l_discount]) AS a, unnest([l_quantity * 1000, l_discount * 500, l_tax]) AS p, unnest(['0', '1', '2']) AS component FROM lineitem),
    b AS (SELECT * FROM x UNION ALL SELECT flag, a, p, 'micro' FROM x), m AS (SELECT *, avg(a) OVER (PARTITION BY flag, component) AS mean FROM b),
    r AS (SELECT flag, component, {", ".join(f'{x} AS "{k}"' for k, x in _REGRESSION.items())} FROM m GROUP BY flag, component),
    e AS (SELECT * FROM r UNION ALL SELECT flag, 'macro', {", ".join(f'avg("{k}")' for k in _REGRESSION)} FROM r WHERE component <> 'micro' GROUP BY flag)
    SELECT flag, component, {", ".join(f'round("{k}", 4) + 0.0 AS "{k}"' for k in _REGRESSION)} FROM e""",
)
def regression_vectors(spark, d):
    x = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.array("l_extendedprice", "l_quantity", "l_discount").alias("y"), F.array(F.col("l_quantity") * 1000, F.col("l_discount") * 500, F.col("l_tax")).alias("guess")
    )
    return M.regression_vectors(x, ["flag"], "y", "guess").select("flag", "component", *((F.round(k, 4) + 0.0).alias(k) for k in _REGRESSION))


def _two_steps() -> list[float]:
    """The kernel at the full rate that equals both steps of a decimation by 12: a filter, then another between every 4th sample."""
    first, second = (S.fir_lowpass(31, 0.8 / k) for k in S.decimation_steps(12))
    wide = np.zeros((len(second) - 1) * 4 + 1)
    wide[::4] = second
    return [float(x) for x in np.convolve(first, wide)]


@query(
    "decimation_steps",
    f"""WITH {SAMPLES}, h(j, h) AS (VALUES {", ".join(f"({j}, {h!r})" for j, h in enumerate(_two_steps()))})
    SELECT s.user_id, CAST(s.t // 12 AS BIGINT) AS t, round(sum(h.h * coalesce(x.value, 0)), 6) + 0.0 AS value FROM samples s CROSS JOIN h LEFT JOIN samples x ON x.user_id = s.user_id AND x.t = s.t - h.j WHERE s.t % 12 = 0 GROUP BY s.user_id, s.t""",
)
def decimation_steps(spark, d):
    return S.decimate(samples(spark, d), "value", STREAM, ["t"], 12).select("user_id", "t", r6("value").alias("value"))


_B, _A = Y.butterworth(1, 0.2)


@query(
    "decimation_iir",
    f"""WITH {WINDOWS} SELECT a.user_id, a.win, CAST(a.k // 4 AS BIGINT) AS k, round(sum(b.value * CASE WHEN a.k = b.k THEN {_B[0]!r} ELSE {_B[1] - _A[1] * _B[0]!r} * power({-_A[1]!r}, a.k - b.k - 1) END), 6) + 0.0 AS value
    FROM windows a JOIN windows b ON a.user_id = b.user_id AND a.win = b.win AND b.k <= a.k WHERE a.k % 4 = 0 GROUP BY a.user_id, a.win, a.k""",
)
def decimation_iir(spark, d):
    arrays = Y.as_arrays(windows(spark, d), ["user_id", "win"], "k", "value")
    return Y.as_samples(Y.each(arrays, Y.decimate(Y.lfilter(_B, _A), 4)), ["user_id", "win"]).select("user_id", "win", "k", r6("value").alias("value"))


def _impulse_sql(b: list[float], a: list[float]) -> str:
    """The filter as a sum over the samples before, with its impulse response from its spectrum."""
    h = np.fft.irfft(np.fft.rfft(b, 1 << 14) / np.fft.rfft(a, 1 << 14))[:16]
    return f"""WITH {WINDOWS}, h(j, h) AS (VALUES {", ".join(f"({j}, {float(x)!r})" for j, x in enumerate(h))})
    SELECT a.user_id, a.win, a.k, round(sum(h.h * b.value), 6) + 0.0 AS value FROM windows a JOIN windows b ON a.user_id = b.user_id AND a.win = b.win AND b.k <= a.k JOIN h ON h.j = a.k - b.k GROUP BY a.user_id, a.win, a.k"""


_LOW, _BAND = Y.elliptic(4, 0.3), Y.elliptic(2, (0.2, 0.4))


def _filtered(spark, d, coefficients):
    arrays = Y.as_arrays(windows(spark, d), ["user_id", "win"], "k", "value")
    return Y.as_samples(Y.each(arrays, Y.lfilter(*coefficients)), ["user_id", "win"]).select("user_id", "win", "k", r6("value").alias("value"))


@query("elliptic_lowpass", _impulse_sql(*_LOW))
def elliptic_lowpass(spark, d):
    return _filtered(spark, d, _LOW)


@query("elliptic_bandpass", _impulse_sql(*_BAND))
def elliptic_bandpass(spark, d):
    return _filtered(spark, d, _BAND)


_DB2 = [(1 + 3**0.5) / (4 * 2**0.5), (3 + 3**0.5) / (4 * 2**0.5), (3 - 3**0.5) / (4 * 2**0.5), (1 - 3**0.5) / (4 * 2**0.5)]


@query(
    "wavelet_db2",
    f"""WITH {WINDOWS}, n AS (SELECT user_id, win, count(*) AS n FROM windows GROUP BY user_id, win), h(j, a, d) AS (VALUES {", ".join(f"({j}, {_DB2[3 - j]!r}, {_DB2[j] * (-1) ** (j + 1)!r})" for j in range(4))}),
    o AS (SELECT user_id, win, n, unnest(range((n + 3) // 2)) AS i FROM n), g AS (SELECT o.*, a, d, (2 * i + 1 - j + 2 * n) % (2 * n) AS m FROM o CROSS JOIN h),
    y AS (SELECT g.user_id, g.win, min(n) AS n, i, sum(a * value) AS a, sum(d * value) AS d FROM g JOIN windows w ON w.user_id = g.user_id AND w.win = g.win AND w.k = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END GROUP BY g.user_id, g.win, i)
    SELECT user_id, win, i AS k, round(a, 6) + 0.0 AS value FROM y UNION ALL SELECT user_id, win, (n + 3) // 2 + i, round(d, 6) + 0.0 FROM y""",
)
def wavelet_db2(spark, d):
    """Approximation, then detail, of each window."""
    arrays = Y.as_arrays(windows(spark, d), ["user_id", "win"], "k", "value")
    return Y.as_samples(Y.each(arrays, Y.dwt(Y.daubechies(2))), ["user_id", "win"]).select("user_id", "win", "k", r6("value").alias("value"))
