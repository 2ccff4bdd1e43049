import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import learners, search


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0.5, 1, (90, 3)), rng.normal(-0.5, 1.5, (110, 3))])
    y = np.array(["a"] * 90 + ["b"] * 110)
    df = spark.createDataFrame([(i, i % 3, l, [float(v) for v in r]) for i, (l, r) in enumerate(zip(y, x))], "id long, fold long, label string, x array<double>").repartition(4)
    return df, x, y


def test_grid_is_cross_validation(data):
    df, x, y = data
    got = {r.tau: (r.Balanced_accuracy_mean, r.Balanced_accuracy_std, r.best) for r in search.grid(df, "fold", "label", "x", "a", "b", [0.1, 50.0]).collect()}
    fold, design, t = np.arange(200) % 3, np.hstack([x, np.ones((200, 1))]), np.where(y == "a", 1.0, -1.0)
    for tau in (0.1, 50.0):
        acc = []
        for k in range(3):
            tr, te = fold != k, fold == k
            w = np.linalg.solve(design[tr].T @ design[tr] + np.diag([tau] * 3 + [0]), design[tr].T @ t[tr])
            p = design[te] @ w > 0
            acc.append((p[t[te] > 0].mean() + (~p[t[te] < 0]).mean()) / 2)
        assert got[tau][0] == pytest.approx(np.mean(acc)) and got[tau][1] == pytest.approx(np.std(acc))
    assert sum(v[2] for v in got.values()) == 1


def test_bayesian_lda_separates(data):
    df, x, y = data
    model = search.bayesian_lda(learners.moments(df, "label", "x"), "a", "b")
    s = x @ model.weights + model.bias
    assert ((s > 0) == (y == "a")).mean() > 0.7
    lda = learners.lda(learners.moments(df, "label", "x"), "a", "b", 0.0)
    assert np.corrcoef(s, x @ lda.weights)[0, 1] > 0.99


def test_xdawn_finds_the_evoked_channel(spark):
    rng = np.random.default_rng(5)
    shape, mix = np.sin(np.arange(8)), np.array([[1.0, 0.4], [0.3, 1.0]])
    rows = []
    for w in range(60):
        label = "t" if w % 2 else "s"
        source = np.stack([shape * 2 * (label == "t") + rng.normal(0, 0.3, 8), rng.normal(0, 3, 8)])
        rows += [(w, k, label, *(float(v) for v in mix @ source[:, k])) for k in range(8)]
    df = spark.createDataFrame(rows, "win long, t long, label string, a double, b double")
    f = search.xdawn(df, "label", "t", "t", ["a", "b"], 1)[:, 0]
    want = np.linalg.inv(mix)[0]
    assert abs(f @ want) / np.linalg.norm(f) / np.linalg.norm(want) > 0.99


def test_random_projection_is_fixed_and_close_to_gaussian(spark):
    df = spark.range(2000).select(F.col("id").alias("row"), F.col("id").alias("f"), F.lit(1.0).alias("x"))
    w = np.array([[r.p0, r.p1] for r in search.random_projection(df, "row", "f", "x", 2).orderBy("row").collect()])
    assert abs(w.mean()) < 0.1 and w.std() == pytest.approx(1, abs=0.05) and abs(np.corrcoef(w.T)[0, 1]) < 0.1
    assert np.allclose(w, [[r.p0, r.p1] for r in search.random_projection(df.repartition(7), "row", "f", "x", 2).orderBy("row").collect()])


def test_ica_unmixes(spark):
    rng = np.random.default_rng(8)
    s = np.stack([rng.uniform(-1, 1, 3000), np.sign(rng.normal(size=3000)) * rng.exponential(1, 3000)], 1)
    mix = np.array([[1.0, 0.6], [-0.4, 1.0]])
    df = spark.createDataFrame([([float(v) for v in r],) for r in s @ mix.T], "x array<double>").repartition(3)
    f = learners.ica(df, "x", 2)
    got = (s @ mix.T - (s @ mix.T).mean(0)) @ f
    c = abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert np.allclose(np.sort(c.max(1)), 1, atol=0.02) and np.allclose(got.T @ got / 3000, np.eye(2), atol=1e-6)


def test_ssnr_rises_under_its_filter(spark):
    rng = np.random.default_rng(9)
    rows = [(w, k, "t", *(float(v) for v in (np.sin(k) + rng.normal(0, 1), rng.normal(0, 2)))) for w in range(40) for k in range(6)]
    df = spark.createDataFrame(rows, "win long, t long, label string, a double, b double")
    f = search.xdawn(df, "label", "t", "t", ["a", "b"], 1)
    assert 0 < search.ssnr(df, "label", "t", "t", ["a", "b"]) < search.ssnr(df, "label", "t", "t", ["a", "b"], f) <= 1
