"""Margin machines by other ways, several classes, searches, stored and self-trained models, frames."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import features, learners, margins, models, search, signal, tables
from sigmill.streaming import adapting


def rows(n=160, d=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.7 * rng.normal(size=n) > 0, 1.0, -1.0)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows()
    return spark.createDataFrame([(k, k % 4, float(b), "a" if b > 0 else "b", a.tolist()) for k, (a, b) in enumerate(zip(x, y))], "id long, fold long, y double, label string, x array<double>").repartition(3).cache()


def objective(w, b, x, y, c, outer, high, weights):
    m, own = y * (x @ w + b), np.where(y > 0, weights[1], weights[0])
    return abs(w).sum() + (own * (c * np.maximum(1 - m, 0) + (high * np.maximum(m - outer, 0) if math.isfinite(outer) else 0))).sum()


@pytest.mark.parametrize("c, outer, high, weights", [(1.0, 2.0, 1.0, (1.0, 1.0)), (0.3, 3.0, 0.1, (1.0, 2.5)), (2.0, math.inf, 2.0, (1.0, 1.0))])
def test_absolute_margin_is_the_linear_program(spark, c, outer, high, weights):
    """Against all vertices: the least objective lies where as many kinks meet as there are unknowns."""
    x, y = rows(9, 2, 8)
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "y double, x array<double>").coalesce(1)
    m = margins.absolute_margin(df, "y", "x", c, outer, high, weights)
    lines = [(np.append(v * s, s), t) for v, s in zip(x, y) for t in (1.0, outer) if math.isfinite(t)] + [(np.eye(3)[k], 0.0) for k in range(2)]
    best = math.inf
    for three in itertools.combinations(lines, 3):
        a = np.array([q[0] for q in three])
        if abs(np.linalg.det(a)) > 1e-9:
            v = np.linalg.solve(a, [q[1] for q in three])
            best = min(best, objective(v[:2], v[2], x, y, c, outer, high, weights))
    assert m.objective == pytest.approx(objective(m.weights, m.bias, x, y, c, outer, high, weights), abs=1e-9)
    assert m.bound <= best + 1e-9 and m.objective == pytest.approx(best, rel=1e-6) and m.passes < 200


def test_margin_by_regression_is_the_relative_margin_machine(table):
    one, two = margins.margin_by_regression(table, "y", "x", 0.7, 3.0), margins.relative_margin(table, "y", "x", 0.7, 3.0)
    assert np.allclose(one.weights, two.weights, atol=1e-5) and one.bias == pytest.approx(two.bias, abs=1e-5)


def exact_kernel_scores(x, y, kernel, width, c):
    k = margins.kernel_values(x, x, kernel, width)
    value, base = np.linalg.eigh(k)
    some = value > 1e-10 * value.max()
    f = np.column_stack([base[:, some] * np.sqrt(value[some]), np.ones(len(x))])
    w = np.zeros(f.shape[1])
    for _ in range(100):
        gap = 1 - y * (f @ w)
        own = f[gap > 0]
        w = w - np.linalg.solve(np.eye(len(w)) + 2 * c * own.T @ own, w - 2 * c * own.T @ (gap[gap > 0] * y[gap > 0]))
    return f @ w


@pytest.mark.parametrize("kernel, width", [("rbf", 0.4), ("poly", 2.0), ("linear", 1.0)])
def test_kernel_machine_on_all_rows_is_exact(spark, kernel, width):
    x, y = rows(40, 3, 5)
    df = spark.createDataFrame([(k, float(b), a.tolist()) for k, (a, b) in enumerate(zip(x, y))], "id long, y double, x array<double>").coalesce(2)
    m = margins.kernel_machine(df, "y", "x", 1.0, kernel, width, 40)
    got = m.score(df.unionByName(spark.createDataFrame([(99, 1.0, None)], df.schema)), "x").orderBy("id").collect()
    assert got[-1].score is None and np.allclose([r.score for r in got[:-1]], exact_kernel_scores(x, y, kernel, width, 1.0), atol=1e-4)


def test_landmarks_are_distinct_rows(spark):
    df = spark.createDataFrame([([float(k % 7), 1.0],) for k in range(200)] + [(None,)], "x array<double>")
    got = margins.landmarks(df, "x", 20)
    assert sorted(v[0] for v in got) == list(range(7))
    assert len(margins.landmarks(df, "x", 3)) == 3 and len(margins.landmarks(df.filter("false"), "x", 3)) == 0


def test_pairs_vote(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "pqrs"[k % 4], (rng.normal(size=3) + np.eye(4)[k % 4][:3] * 2).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, x array<double>")
    m = learners.moments(df, "c", "x")
    pairs = learners.one_against_one(m)
    assert list(pairs) == list(itertools.combinations("pqrs", 2))
    got = {r.id: r for r in learners.vote_of_pairs(df, pairs, "x").collect()}
    for i, _, x in rows:
        score = {p: float(np.dot(x, w.weights) + w.bias) for p, w in pairs.items()}
        won = {c: (sum((s > 0) if a == c else (s <= 0) for (a, b), s in score.items() if c in (a, b)), sum(s if a == c else -s for (a, b), s in score.items() if c in (a, b))) for c in "pqrs"}
        best = max("pqrs", key=lambda c: (*won[c], -ord(c)))
        assert (got[i].predicted, got[i].votes) == (best, won[best][0])
    two = learners.lda(learners.moments(df.filter("c IN ('p', 'r')"), "c", "x"), "p", "r")
    assert np.allclose(pairs["p", "r"].weights, two.weights)
    rest = learners.one_against_rest(m, learners.ridge_classifier)
    other = learners.ridge_classifier(learners.moments(df.withColumn("c", F.when(F.col("c") == "q", "q").otherwise("rest")), "c", "x"), "q", "rest")
    assert np.allclose(rest["q"].weights, other.weights)


def test_parameter_search(table):
    fit = lambda m, a, b, tau, shift: learners.Linear((r := learners.ridge_classifier(m, a, b, tau)).weights, r.bias + shift)
    grid = {"tau": [0.1, 10.0, 1e9], "shift": [0.0, 5.0]}
    found = search.parameter_search(table, "fold", "label", "x", "a", "b", fit, grid, std_weight=0.3, each=["shift"])
    got = {(r.tau, r["shift"]): r for r in found.table.collect()}
    x, y = rows()
    for (tau, shift), r in got.items():
        values = []
        for k in range(4):
            train = np.arange(len(y)) % 4 != k
            c = learners.Moments({s: int((y[train] == v).sum()) for s, v in (("a", 1), ("b", -1))}, {s: x[train][y[train] == v].sum(0) for s, v in (("a", 1), ("b", -1))}, {s: x[train][y[train] == v].T @ x[train][y[train] == v] for s, v in (("a", 1), ("b", -1))})
            w = fit(c, "a", "b", tau, shift)
            p = x[~train] @ w.weights + w.bias > 0
            values.append((p[y[~train] > 0].mean() + (~p)[y[~train] < 0].mean()) / 2)
        assert (r["mean"], r["std"]) == (pytest.approx(np.mean(values)), pytest.approx(np.std(values), abs=1e-9)) and r.objective == pytest.approx(np.mean(values) - 0.3 * np.std(values))
    assert sum(r.best for r in got.values()) == 2
    assert found.best["shift"] == 0.0 and got[found.best["tau"], 0.0].best
    whole = fit(learners.moments(table, "label", "x"), "a", "b", **found.best)
    assert np.allclose(found.model.weights, whole.weights)
    worst = search.parameter_search(table, "fold", "label", "x", "a", "b", fit, grid, inverse=True)
    assert worst.best["shift"] == 5.0 and worst.best["tau"] in (0.1, 10.0, 1e9)
    same = search.parameter_search(table, "fold", "label", "x", "a", "b", lambda m, a, b, k: learners.nearest_mean(m, a, b), {"k": [3, 1, 2]})
    assert same.best == {"k": 3}


def test_store(spark, table, tmp_path):
    path = f"{tmp_path}/store"
    part, rest = table.filter("id % 3 = 0"), table.filter("id % 3 <> 0")
    some = [models.Model(f"m_{k}", k, "a", "b", learners.moments(part, "label", "x"), p) for k, p in (("lda", {"ridge": 1e-3}), ("qda", {}), ("ridge", {"tau": 2.0}), ("bayesian", {}), ("nearest_mean", {}))]
    models.save(spark, some, path)
    models.save(spark, [models.Model("mx100%", "lda", "a", "b", some[0].sums)], path)
    assert [m.name for m in models.load(spark, path, "m_*")] == sorted(m.name for m in some)
    assert [m.name for m in models.load(spark, path, "m?100%")] == ["mx100%"]
    for m, own in zip(models.load(spark, path, "m_*"), sorted(some, key=lambda m: m.name)):
        adapted, whole = m.adapted(learners.moments(rest, "label", "x")).fitted(), models.Model("", m.kind, "a", "b", learners.moments(table, "label", "x"), m.parameters).fitted()
        if m.kind != "qda":
            assert np.allclose(m.fitted().weights, own.fitted().weights) and np.allclose(adapted.weights, whole.weights)
        else:
            assert np.allclose(m.fitted().a, own.fitted().a) and np.allclose(adapted.a, whole.a)
    cache = f"{tmp_path}/cache"
    twice = table.unionByName(table.limit(5)).unionByName(spark.createDataFrame([(999, 0, 1.0, "a", None)], table.schema))
    want = sorted((r.id, tuple(sorted(r.scores.items())) if r.scores and r.id != 999 else None) for r in models.apply_all(twice, some[:2], "x").collect())
    for _ in range(2):
        got = models.cached_scores(twice, some[:2], "x", cache)
        assert sorted((r.id, tuple(sorted(r.scores.items())) if r.scores else None) for r in got.collect()) == want
        assert spark.read.parquet(cache).count() == 2 * table.count()
    models.cached_scores(table, some, "x", cache).count()
    assert spark.read.parquet(cache).count() == len(some) * table.count()


def test_self_training_is_a_loop_over_batches(spark, table, tmp_path):
    root, x = str(tmp_path), "id long, x array<double>"
    start = models.Model("s", "lda", "a", "b", learners.moments(table.filter("id < 30"), "label", "x"))
    model = start
    for k in range(3):
        batch = table.filter(f"id >= 30 AND id % 3 = {k}").select("id", "x")
        batch.coalesce(1).write.mode("append").parquet(f"{root}/in")
        adapting.self_train(spark.readStream.schema(x).parquet(f"{root}/in"), model if k == 0 else start, "x", root, 0.1, 0.8).awaitTermination()  # stops, and goes on from the checkpoint
        scored = batch.withColumn("score", model.score("x"))
        got = {r.id: r.score for r in spark.read.parquet(f"{root}/predictions/batch={k}").collect()}
        assert got == pytest.approx({r.id: r.score for r in scored.collect()})
        own = adapting.confident(scored, "a", "b", 0.1, 0.8)
        assert all(abs(r.score - 0.1) > 0.8 and r.own_label == ("a" if r.score > 0.1 else "b") for r in own.collect())
        model = model.adapted(learners.moments(own, "own_label", "x"))
        last = adapting.last_model(spark, root)
        assert np.allclose(last.fitted().weights, model.fitted().weights) and last.sums.n == model.sums.n


def test_frames(spark):
    rng = np.random.default_rng(4)
    series = {"a": rng.normal(size=37), "b": np.zeros(12), "c": rng.normal(size=5)}
    df = spark.createDataFrame([(k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)], "k string, t long, v double")
    for frame, hop in ((8, 8), (8, 3), (6, 1)):
        got = {(r.k, r.frame, r.bin): r for r in features.stft(df, "v", ["k"], "t", frame, hop, 50.0).collect()}
        want = {}
        for k, s in series.items():
            for f in range((len(s) - frame) // hop + 1 if len(s) >= frame else 0):
                w = np.hanning(frame)
                p = abs(np.fft.rfft(s[f * hop : f * hop + frame] * w)) ** 2 / (50.0 * (w**2).sum())
                p[1:-1] *= 2
                want |= {(k, f, b): v for b, v in enumerate(p)}
        assert got.keys() == want.keys()
        for i, v in want.items():
            assert got[i].power == (pytest.approx(10 * math.log10(v), abs=1e-6) if v > 1e-20 else None) and got[i].frequency == i[2] * 50.0 / frame and got[i].time == (i[1] * hop + frame / 2) / 50.0
    few = features.stft(df, "v", ["k"], "t", 8, 8, 50.0, (10.0, 20.0))
    assert {r.bin for r in few.collect()} == {2, 3}
    with pytest.raises(ValueError):
        features.stft(df, "v", ["k"], "t", 7, 3)


def test_forecasts_of_short_and_regular_windows(spark):
    rng = np.random.default_rng(6)
    series = {"a": rng.normal(size=30).cumsum(), "b": np.ones(20), "c": rng.normal(size=3), "d": np.arange(12.0), "e": rng.normal(size=1)}
    df = spark.createDataFrame([(k, t, float(v)) for k, s in series.items() for t, v in enumerate(s)], "k string, t long, v double")
    got = {r.k: r.coefficients for r in features.autoregressive(df, "v", ["k"], "t", 3).collect()}
    x = series["a"]
    design = np.column_stack([np.ones(27), *(x[3 - k : 30 - k] for k in (1, 2, 3))])
    assert got["a"] == pytest.approx(np.linalg.lstsq(design, x[3:], rcond=None)[0][1:].tolist())
    assert got["b"] is None and got["d"] is None and "c" not in got and "e" not in got
    assert features.autoregressive(df.filter("false"), "v", ["k"], "t", 2).count() == 0


def test_subsampling_of_a_line_is_a_line(spark):
    """Between the ends of the filter; and what no factor changes stays in length."""
    df = spark.createDataFrame([("a", t, 2.0 * t) for t in range(200)] + [("b", 0, 1.0)], "k string, t long, v double")
    up = {(r.k, r.t): r.v for r in signal.interpolate(df, "v", ["k"], "t", 4, length=64).collect()}
    assert len(up) == 199 * 4 + 1 + 1 and all(up["a", t] == pytest.approx(t / 2) for t in range(797))
    out = sorted((r.t, r.v) for r in signal.subsample(df.filter("k = 'a'"), "v", ["k"], "t", 100.0, 60.0, 9).collect())
    assert len(out) == 120 and np.allclose(np.diff([v for t, v in out if t > 5]), 2.0 * 5 / 3)
    assert signal.subsample(df, "v", ["k"], "t", 100.0, 50.0).filter("k = 'a'").count() == 100


def test_projection_drops_what_says_nothing(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "p string, m int")
    assert tables.project(df, "p", ["x"]).columns == ["m"] and tables.project(df, "p", ["x", "y"]).count() == 2 and tables.project(df, "p", ["z"]).count() == 3
