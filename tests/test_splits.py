"""Folds along a recording, decimation steps and wavelet kernels on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import search, selection, thresholds
from sigmill.operators import signal as S
from sigmill.operators import splits as P
from sigmill.operators import windowed as Y
from sigmill.operators.segments import running


def by_t(df, *cols):
    return [tuple(r) for r in df.select("t", *cols).orderBy("t", *cols).collect()]


def test_a_null_flag_begins_no_set_and_streams_are_apart(spark):
    df = spark.createDataFrame([(s, t, f) for s in (1, 2) for t, f in enumerate([None, False, True, None, True])], "s int, t long, f boolean")
    got = P.flag_segments(df, ["s"], F.floor(F.col("t") / 2), ["t"], F.col("f"))
    assert [r["segment"] for r in got.orderBy("s", "t").collect()] == [0, 0, 1, 1, 2] * 2


def test_a_segment_left_over_by_the_count_joins_the_one_before(spark):
    df = spark.createDataFrame([(1, t, "a" if t % 2 else "b") for t in range(10)], "s int, t long, name string")  # 5 counted
    counted = F.col("name") == "a"
    assert by_t(P.count_segments(df, ["s"], F.floor(F.col("t") / 3), ["t"], counted, 4), "segment") == [(t, s) for t, s in enumerate([0, 0, 0, 1, 1, 2, 2, 3, 3, 3])]
    assert [s for _, s in by_t(P.count_segments(df, ["s"], F.floor(F.col("t") / 3), ["t"], counted, 2), "segment")] == [0] * 7 + [1] * 3


def test_one_instant_and_no_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 5)], "s int, t long")
    assert by_t(P.time_segments(df, ["s"], "t", 3), "segment") == [(5, 0), (5, 0)]
    assert P.time_segments(df.limit(0), ["s"], "t", 3).count() == 0


def test_each_fold_tests_on_its_segment_only(spark):
    df = spark.createDataFrame([(1, t, t // 2, "ab"[t % 2]) for t in range(6)], "s int, t long, segment long, name string")
    got = P.leave_segment_out(df, ["s"], "name", ["a"], ["b"]).collect()
    assert sorted((r.fold, r.t) for r in got if r.part == "test") == [(0, 1), (1, 3), (2, 5)]
    assert sorted((r.fold, r.t) for r in got if r.part == "train") == [(0, 2), (0, 4), (1, 0), (1, 4), (2, 0), (2, 2)]


@pytest.mark.parametrize("factor, steps", [(4, [4]), (12, [4, 3]), (13, [13]), (16, [4, 4]), (30, [6, 5])])
def test_decimation_steps(factor, steps):
    assert S.decimation_steps(factor) == steps


@pytest.mark.parametrize("order", [1, 2, 3, 4, 6])
def test_wavelet_kernels_are_orthonormal_with_vanishing_moments(order):
    h = np.array(Y.daubechies(order))
    for shift in range(0, 2 * order, 2):
        assert h[shift:] @ h[: len(h) - shift] == pytest.approx(float(shift == 0), abs=1e-6)
    g = h[::-1] * (-1.0) ** np.arange(len(h))
    assert all(abs(g @ np.arange(len(h)) ** m) < 1e-4 for m in range(order))


@pytest.mark.parametrize("order, n", [(1, 8), (1, 7), (2, 1), (2, 5), (3, 16)])
def test_wavelet_of_a_constant_has_no_detail(order, n):
    y = Y.dwt(Y.daubechies(order))(np.full((2, n), 3.0))
    half = (n + 2 * order - 1) // 2
    assert y.shape == (2, 2 * half)
    assert np.allclose(y[:, :half], 3 * 2**0.5) and np.allclose(y[:, half:], 0, atol=1e-9)


@pytest.mark.parametrize("order, band", [(1, 0.3), (4, 0.25), (5, 0.5), (2, (0.2, 0.4)), (3, (0.1, 0.3))])
def test_elliptic_filters_keep_their_pass_band_and_stop_the_rest(order, band):
    b, a = Y.elliptic(order, band, 0.5, 60.0)
    f = np.linspace(0, 1, 5001)
    z = np.exp(-1j * np.pi * f)
    level = 20 * np.log10(np.maximum(abs(np.polyval(b[::-1], z) / np.polyval(a[::-1], z)), 1e-12))
    low, high = band if isinstance(band, tuple) else (0.0, band)
    inside = (f >= low) & (f <= high)
    assert -0.5001 < level[inside].min() and level[inside].max() < 1e-4
    for side in (level[f > high], level[f < low][::-1]):  # once stopped, it stays so
        if len(side):
            stopped = np.flatnonzero(side <= -60)
            assert len(stopped) and side[stopped[0] :].max() < -59.999
    assert abs(np.roots(a)).max() < 1


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_running_aggregates_equal_plain_ones(spark, width):
    rng = np.random.default_rng(3)
    rows = [(int(s), int(t), float(v)) for s, t, v in zip(rng.integers(0, 2, 60), rng.permutation(60), rng.normal(size=60))]
    df = spark.createDataFrame(rows, "s int, t long, v double")
    values = {"total": (F.sum, F.when(F.col("v") > 0, F.col("v"))), "high": (F.max, F.col("v")), "low": (F.min, F.col("v"))}
    for itself in (True, False):
        got = {r.t: (r.total, r.high, r.low) for r in running(df, ["s"], F.floor(F.col("t") / width), ["t"], values, itself).collect()}
        assert len(got) == 60
        for s, t, _ in rows:
            v = [x for o, u, x in rows if o == s and (u <= t if itself else u < t)]
            plain = (sum(x for x in v if x > 0) if any(x > 0 for x in v) else None, max(v, default=None), min(v, default=None))
            assert got[t] == pytest.approx(plain) if None not in plain else got[t] == plain or got[t][1:] == pytest.approx(plain[1:])


@pytest.mark.parametrize("width", [1, 10, 10_000])
def test_groups_and_trials_that_cross_ranges(spark, width):
    """One long window holds the later ones together; a trial runs over many ranges."""
    df = spark.createDataFrame([(1, 0, 100), (1, 5, 6), (1, 50, 60), (1, 101, 102), (1, 102, 110), (1, 200, 201), (2, 7, 8)], "s int, a long, b long")
    bucket = F.floor(F.col("a") / width)
    got = selection.groups_in_time(df, ["s"], "a", "b", bucket).orderBy("s", "a").collect()
    assert [r["group"] for r in got] == [1, 1, 1, 2, 2, 3, 1]
    got = thresholds.trials(df, ["s"], "a", "b", 50, bucket).orderBy("s", "a").collect()
    assert [(r.trial, r.place) for r in got] == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (1, 1)]
    assert thresholds.trials(df.limit(0), ["s"], "a", "b", 50, bucket).columns == ["s", "a", "b", "trial", "place"]


def test_a_sparse_filter_keeps_the_channels_that_carry_the_response():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=(400, 5))
    power = noise.T @ noise + np.diag([60.0, 0, 0, 90.0, 0])
    signal = np.zeros((5, 5))
    signal[np.ix_([0, 3], [0, 3])] = [[60.0, 70.0], [70.0, 90.0]]
    chosen, w = search.sparse_filter(signal, power, 2, 0.05)
    assert chosen == [0, 3] and np.linalg.norm(w) == pytest.approx(1) and (w > 0).all()
    ratio = lambda v: (v @ signal @ v) / (v @ power @ v)
    own = np.zeros(5)
    own[chosen] = w
    assert all(ratio(own) >= 0.9 * ratio(v) for v in rng.normal(size=(500, 5)))
    assert search.sparse_filter(signal, power, 1, 0.5)[0] in ([0], [3])
