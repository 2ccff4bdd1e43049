"""Ranges of values, and what is added up over them, against plain versions; ranges are made small so that there are many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import convert, ensemble, features, generators, metrics, normalize, priors, search, segments, signal, tables, thresholds


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(segments, "RANGE_ROWS", 4)


def test_ranges_follow_the_values(spark, small):
    rng = np.random.default_rng(1)
    near, far = rng.normal(size=400) * 1e-3, [1e9, -1e300, 1e300, float("inf"), float("-inf"), float("nan"), None]
    rows = [("a", v) for v in (*near.tolist(), *far)] + [("one", 5.0)] * 3 + [("null", None)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = segments.value_ranges(df, ["k"], "v", "r").collect()
    assert len(got) == len(rows) - 1
    own = [(x.v, x.r) for x in got if x.k == "a"]
    order = sorted(own, key=lambda x: (0, 0) if x[0] is None else (2, 0) if np.isnan(x[0]) else (1, x[0]))
    assert all(a[1] <= b[1] for a, b in zip(order, order[1:]))
    assert [order[0][0], order[1][0]] == [None, float("-inf")] and len({r for _, r in order[:2]}) == 2
    plain = segments.value_ranges(df.filter("k = 'a' AND abs(v) < 1"), ["k"], "v", "r").groupBy("r").count()
    assert plain.count() >= 80 and plain.agg(F.max("count")).first()[0] <= 24
    skewed = segments.value_ranges(df.filter("k = 'a' AND abs(v) <= 1e9"), ["k"], "v", "r").groupBy("r").count()
    assert skewed.agg(F.max("count")).first()[0] <= 24  # one far value: the second cut mends it
    assert {x.r for x in got if x.k == "one"} == {0} and segments.value_ranges(df, [], "v", "r").count() == len(rows)
    assert segments.value_ranges(df.filter("false"), ["k"], "v", "r").count() == 0


def test_quantiles_against_numpy(spark, small):
    rng = np.random.default_rng(2)
    values = {"a": rng.normal(size=301), "b": np.repeat(rng.normal(size=7), 40), "c": np.array([2.5]), "d": np.exp(rng.normal(size=200) * 8)}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("nothing", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.05, 0.5, 0.731, 1.0]
    got = {r.k: r.quantiles for r in normalize.quantiles(df, "k", "v", shares).collect()}
    assert set(got) == {*values, "nothing"} and got["nothing"] == [None] * 5
    for k, v in values.items():
        assert got[k] == pytest.approx(np.quantile(v, shares).tolist(), rel=1e-12)
    ends = {r.k: (r["shift"], r["factor"]) for r in normalize.outlier(df, "k", "v").collect()}
    for k, v in values.items():
        low, high = np.quantile(v, [0.05, 0.95])
        assert ends[k] == pytest.approx((low, 1.0 if low == high else 1 / (high - low)))


def test_thresholds_and_points_against_loops(spark, small):
    rng = np.random.default_rng(3)
    rows = [(g, float(s), int(y)) for g, size in (("a", 150), ("b", 1), (None, 40)) for s, y in zip(rng.normal(size=size).round(2) * 10.0 ** rng.integers(-2, 3, size=size), rng.integers(0, 2, size=size))]
    df = spark.createDataFrame(rows, "g string, score double, y int")
    points = {(r.g, r.threshold): (r.tp, r.fp, r.positives, r.negatives) for r in metrics.roc_points(df, ["g"], "y", "score", 1).collect()}
    for g in ("a", "b", None):
        own = [(round(s, 3), y) for k, s, y in rows if k == g]
        for at in {s for s, _ in own}:
            want = sum(y for s, y in own if s >= at), sum(1 - y for s, y in own if s >= at), sum(y for _, y in own), sum(1 - y for _, y in own)
            assert points[g, at] == want
    assert len(points) == len({(g, round(s, 3)) for g, s, _ in rows})
    everything = metrics.roc_points(df, [], "y", "score", 1).agg(F.max("tp"), F.max("fp"), F.count("*")).first()
    assert tuple(everything) == (sum(y for *_, y in rows), sum(1 - y for *_, y in rows), len({round(s, 3) for _, s, _ in rows}))
    # the sweep: from a threshold on is positive; the best of equals is the lowest
    own = [(s, y) for g, s, y in rows if g == "a"]
    p, n = sum(y for _, y in own), sum(1 - y for _, y in own)
    value = {at: (sum(y for s, y in own if s >= at) / p + sum(1 - y for s, y in own if s < at) / n) / 2 for at in {s for s, _ in own}}
    sweep = {r.threshold: (r.value, r.best) for r in ensemble.threshold_sweep(df, ["g"], "y", 1).filter("g = 'a'").collect()}
    assert {k: v for k, (v, _) in sweep.items()} == pytest.approx(value)
    assert [k for k, (_, best) in sweep.items() if best] == [min(k for k, v in value.items() if round(v, 12) == round(max(value.values()), 12))]
    # and the threshold below which all is negative
    below = {at: (sum(y for s, y in own if s > at) / p + sum(1 - y for s, y in own if s <= at) / n) / 2 for at in value}
    best = thresholds.best_threshold(df, ["g"], "y", 1).filter("g = 'a'").first()
    assert best.value == pytest.approx(max(below.values()))


@pytest.mark.parametrize("sets", [2, 1 << 15])
def test_time_is_made_monotone(spark, sets):
    rng = np.random.default_rng(4)
    starts = rng.integers(0, 50, size=60).astype(float)
    df = spark.createDataFrame([("a", t, s, s + 3) for t, s in enumerate(starts.tolist())] + [("b", 0, 1.0, 2.0)], "k string, t long, a double, b double")
    got = {(r.k, r.t): (r.a, r.b) for r in signal.monotone_time(df, ["k"], ["t"], "a", "b", F.floor(F.col("t") / 7), sets).collect()}
    base, largest, want = 0.0, 0.0, {("b", 0): (1.0, 2.0)}
    for t, s in enumerate(starts):
        if t and s < starts[t - 1]:
            base, largest = base + largest, 0.0
        largest = max(largest, s + 3)
        want["a", t] = (s + base, s + 3 + base)
    assert got == want


def test_moving_average_fit(spark):
    """Against two least-squares fits by numpy; a long series gives about the numbers that made it."""
    rng = np.random.default_rng(5)
    e = rng.normal(size=4000)
    x = np.zeros(4000)
    for t in range(1, 4000):
        x[t] = 0.6 * x[t - 1] + e[t] + 0.4 * e[t - 1]
    series = {"long": x, "short": x[:30], "flat": np.ones(25), "tiny": x[:4]}
    df = spark.createDataFrame([(k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)], "k string, t long, v double")
    got = {r.k: r.coefficients for r in features.moving_average(df, "v", ["k"], "t", 1, 1, 5).collect()}
    assert got["flat"] is None and "tiny" not in got
    assert got["long"] == pytest.approx([0.6, 0.4], abs=0.06)
    s = series["short"]
    design = np.column_stack([np.ones(25), *(s[5 - k : 30 - k] for k in range(1, 6))])
    shock = s[5:] - design @ np.linalg.lstsq(design, s[5:], rcond=None)[0]
    second = np.column_stack([np.ones(24), s[5:29], shock[:-1]])
    assert got["short"] == pytest.approx(np.linalg.lstsq(second, s[6:], rcond=None)[0][1:].tolist())


def test_what_follows_a_table(spark):
    """Windows, settings and spaces have a row for each of a table's rows or values; the mixing is the same in plain Python."""
    df = spark.createDataFrame([(7, "x"), (8, "y"), (9, None)], "n long, p string")
    w = generators.windows_for(df, "n", "p", {"x": generators.constant(2.0), "y": generators.time_point}, 3, 2)
    got = sorted((r.n, r.t, r.channel, r.value) for r in w.collect())
    assert got == sorted([(7, t, c, 2.0) for t in range(3) for c in range(2)] + [(8, t, c, 24.0 + t) for t in range(3) for c in range(2)])
    assert [r.k for r in priors.settings_for(df, "n", u=priors.uniform_between(F.col("k"), 0.0, 1.0)).orderBy("k").collect()] == [7, 8, 9]
    space = tables.seen_settings(df, ["n", "p"], "NOT (n = 7 AND p = 'y')")
    assert sorted((r.n, r.p) for r in space.collect()) == [(7, "x"), (8, "x"), (8, "y"), (9, "x"), (9, "y")]
    with pytest.raises(ValueError, match="too many"):
        tables.seen_settings(df, ["n", "p"], most=2)

    def mixed(k):
        k %= 1 << 32
        for _ in range(2):
            k = (k ^ k >> 16) * 73244475 % (1 << 32)
        return k ^ k >> 16

    numbers = [0, 1, 7, 1 << 31, (1 << 32) - 1, 1 << 40, -3]
    assert [r[0] for r in spark.createDataFrame([(k,) for k in numbers], "k long").select(generators.mixed(F.col("k"))).collect()] == [mixed(k) for k in numbers]
    named = spark.createDataFrame([("a", "f1", 1.0), ("a", "f2", 2.0), ("b", "f1", 1.0)], "id string, f string, x double")
    assert search.random_projection(named, "id", "f", "x", 2).count() == 2
    ones = spark.createDataFrame([(1, k, float(k)) for k in range(4)], "win long, k long, v double")
    weights = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (3, 2, 0.5), (2, 2, 0.0)], "i long, t long, weight double")
    assert sorted((r.k, r.v) for r in convert.mapped(ones, weights, ["win"], "k", "v").collect()) == [(0, 2.0), (2, 1.5)]
