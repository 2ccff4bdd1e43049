"""Queries that SQL can't express, row by row against numpy on the whole table; and readers and searches on small input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.operators import margins as A
from sigmill.operators import search as H
from sigmill.operators import sensors as E
from sigmill.operators import thresholds as T
from sigmill.plans import registry
from sigmill.sources import edf

DATA = "/root/testdata/sf0.001"
Q = registry.queries()


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    return np.array([r.vec_id for r in rows]), np.array([r.label for r in rows]) % 2, x


def by_id(df, *columns):
    rows = {r["id"]: r for r in df.collect()}
    return np.array([[rows[k][c] for c in columns] for k in sorted(rows)], float)


def close(got, want, digits):
    assert got.shape == want.shape
    assert np.abs(got - want).max() <= 0.6 * 10.0**-digits + 1e-6 * np.abs(want).max()


def moments(x):
    return len(x), x.mean(0), np.cov(x.T, bias=True)


def test_lda(spark, vectors):
    i, odd, x = vectors
    train = i % 2 == 0
    (na, ma, ca), (nb, mb, cb) = moments(x[train & (odd == 0)]), moments(x[train & (odd == 1)])
    cov = (na * ca + nb * cb) / (na + nb)
    cov += 1e-6 * np.trace(cov) / len(cov) * np.eye(len(cov))
    w = np.linalg.solve(cov, ma - mb)
    close(by_id(Q["lda"](spark, DATA), "score")[:, 0], x @ w - (ma + mb) @ w / 2 + np.log(na / nb), 5)


def test_qda(spark, vectors):
    i, odd, x = vectors
    train, log = i % 2 == 0, []
    for c in (0, 1):
        n, mean, cov = moments(x[train & (odd == c)])
        cov += 1e-3 * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = x - mean
        log.append(np.log(n) - 0.5 * (np.linalg.slogdet(cov)[1] + (d @ np.linalg.inv(cov) * d).sum(1)))
    close(by_id(Q["qda"](spark, DATA), "score")[:, 0], log[0] - log[1], 4)


def test_ridge_classifier(spark, vectors):
    i, odd, x = vectors
    train = i % 2 == 0
    y = 1.0 - 2 * odd[train]
    mean = x[train].mean(0)
    w = np.linalg.solve((x[train] - mean).T @ (x[train] - mean) + np.eye(x.shape[1]), (x[train] - mean).T @ y)
    close(by_id(Q["ridge_classifier"](spark, DATA), "score")[:, 0], (x - mean) @ w + y.mean(), 5)


def up_to_sign(got, want, digits):
    for k in range(want.shape[1]):
        sign = np.sign(got[:, k] @ want[:, k])
        close(got[:, k], sign * want[:, k], digits)


def projected(df):
    return np.array([r["projected"] for r in df.orderBy("id").collect()], float)


def test_pca(spark, vectors):
    _, _, x = vectors
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    up_to_sign(projected(Q["pca"](spark, DATA)), x @ v[:4].T, 4)


def test_fda_direction(spark, vectors):
    """The projection separates training classes as no other direction does: it is the discriminant's, up to scale."""
    i, odd, x = vectors
    train = i % 2 == 0
    (na, ma, ca), (nb, mb, cb) = moments(x[train & (odd == 0)]), moments(x[train & (odd == 1)])
    w = np.linalg.solve((na * ca + nb * cb) / (na + nb), ma - mb)
    got, want = projected(Q["fda"](spark, DATA))[:, 0], x @ w
    assert abs(np.corrcoef(got, want)[0, 1]) > 0.999


def test_csp_is_diagonal(spark, vectors):
    """Both classes' second moments are diagonal after the filters."""
    i, odd, x = vectors
    got, train = projected(Q["csp"](spark, DATA)), i % 2 == 0
    for c in (0, 1):
        own = got[train & (odd == c)]
        m = own.T @ own / len(own)
        assert np.abs(m - np.diag(np.diag(m))).max() < 1e-2 * np.abs(np.diag(m)).max()


def newton(x, target, loss, bias=None, rounds=200):
    """Plain damped Newton on |w|^2 / 2 + losses with a numeric check of the gradient's size at the end."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    free = slice(None) if bias is None else slice(0, -1)
    if bias is not None:
        w[-1] = bias
    pen = np.append(np.ones(x.shape[1]), 0.0)
    for _ in range(rounds):
        g, h, _ = loss(target, x1 @ w)
        grad, hess = (x1 * g[:, None]).sum(0) + pen * w, (x1 * h[:, None]).T @ x1 + np.diag(pen + 1e-9)
        step = np.zeros_like(w)
        step[free] = np.linalg.solve(hess[free, free], grad[free])
        size, value = 1.0, lambda v: pen @ (v * v) / 2 + loss(target, x1 @ v)[2].sum()
        while size > 1e-8 and value(w - size * step) > value(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return x1 @ w


def margin_loss(c, outer):
    def loss(y, f):
        m = y * f
        low, high = np.maximum(1 - m, 0), np.maximum(m - outer, 0)
        return 2 * c * y * (high - low), 2 * c * ((low > 0) | (high > 0)).astype(float), c * (low**2 + high**2)

    return loss


def fitted(x, train, target, loss, bias=None):
    x1 = np.hstack([x, np.ones((len(x), 1))])
    f = newton(x[train], target, loss, bias)
    w = np.linalg.lstsq(x1[train], f, rcond=None)[0]
    return x1 @ w


def test_relative_margin(spark, vectors):
    i, odd, x = vectors
    train = i % 4 != 0
    want = fitted(x, train, (1.0 - 2 * odd)[train], margin_loss(0.1, 2.0))
    close(by_id(Q["relative_margin"](spark, DATA), "score")[:, 0], want, 3)


def test_regression(spark, vectors):
    i, odd, x = vectors

    def loss(y, f):
        r = f - y
        over = np.sign(r) * np.maximum(np.abs(r) - 0.1, 0)
        return 0.2 * over, 0.2 * (over != 0), 0.1 * over**2

    close(by_id(Q["support_vector_regression"](spark, DATA), "predicted")[:, 0], fitted(x, np.ones(len(x), bool), 1.0 - 2 * odd, loss), 3)


def test_one_class_margin(spark, vectors):
    _, odd, x = vectors
    got = by_id(Q["one_class_margin"](spark, DATA), "margin")[:, 0]
    own = got[odd == 0]
    assert len(got) == len(x) and own.mean() > 0
    w = np.linalg.lstsq(x, got, rcond=None)[0]  # f + 1 with the offset fixed at -1 is linear through the origin
    close(x @ w, got, 3)

    def objective(v):
        m = x[odd == 0] @ v - 1
        return v @ v / 2 + 0.1 * (np.maximum(1 - m, 0) ** 2 + np.maximum(m - 3, 0) ** 2).sum()

    rng = np.random.default_rng(0)
    assert all(objective(w) <= objective(w + 0.02 * rng.normal(size=len(w))) for _ in range(200))


def test_data_description(spark, vectors):
    _, odd, x = vectors
    own = x[odd == 0]
    ball = A.data_description(spark.createDataFrame([(r.tolist(),) for r in own], "x array<double>"), "x", 0.5)
    loss = lambda c: (np.maximum(np.linalg.norm(own - c, axis=1) - 0.5, 0) ** 2).sum()
    rng = np.random.default_rng(0)
    assert all(loss(ball.centre) <= loss(ball.centre + 1e-2 * rng.normal(size=x.shape[1])) for _ in range(100))
    got = by_id(Q["data_description"](spark, DATA), "plain")[:, 0]
    close(got, np.linalg.norm(x - ball.centre, axis=1) - 0.5, 4)


def test_least_complexity(spark):
    df = spark.createDataFrame([(1.0, [2.0, 0.1]), (1.0, [1.5, -0.2]), (-1.0, [-1.0, 0.3]), (-1.0, [-2.0, 0.0])], "y double, x array<double>")
    c = A.least_complexity(df, "y", "x", 1e-3, 1e3, 0.5)
    model = A.relative_margin(df, "y", "x", c, float("inf"))
    assert df.filter(F.col("y") * model.score("x") <= 0).isEmpty()
    mixed = df.unionByName(df.withColumn("y", -F.col("y")))
    assert A.least_complexity(mixed, "y", "x", 1e-1, 1e1, 1.0) is None


def test_channels(spark):
    rng = np.random.default_rng(2)
    powers = E.Powers(*(m @ m.T for m in (rng.normal(size=(6, 4)), rng.normal(size=(6, 9)))))
    value = lambda own: powers.ssnr(own, 1)
    from itertools import combinations

    best = max(combinations(range(6), 3), key=lambda own: value(list(own)))
    assert E.evolutionary_search(6, 3, value, rounds=200) == list(best)
    assert len(E.backward_elimination(6, 3, value)) == len(E.forward_selection(6, 3, value)) == 3
    rows = {r.how: r for r in Q["channels_by_ssnr"](spark, DATA).collect()}
    assert rows["evolution"].ssnr >= max(rows["forward"].ssnr, rows["backward"].ssnr) - 1e-9


def test_channels_by_performance(spark, vectors):
    i, odd, x = vectors
    got = {(r.how, r.entry): r["mean"] for r in Q["channels_by_performance"](spark, DATA).collect()}
    assert len(got) == 2 * x.shape[1] - 1

    def accuracy(columns):
        out = []
        for fold in range(4):
            train, test = i % 4 != fold, i % 4 == fold
            y, own = 1.0 - 2 * odd, x[:, columns]
            mean = own[train].mean(0)
            w = np.linalg.solve((own[train] - mean).T @ (own[train] - mean) + np.eye(len(columns)), (own[train] - mean).T @ y[train])
            hit = ((own[test] - mean) @ w + y[train].mean() > 0) == (odd[test] == 0)
            out.append((hit[odd[test] == 0].mean() + hit[odd[test] == 1].mean()) / 2)
        return np.mean(out)

    for k in (0, 5, 63):
        assert got["without", k] == pytest.approx(accuracy([c for c in range(64) if c != k]), abs=1e-5)
    assert got["with", 7] == pytest.approx(accuracy([0, 7]), abs=1e-5)


def test_pattern_search():
    asked = []

    def value(points):
        asked.append(len(points))
        return [-((p[0] - 1.3) ** 2) - (p[1] + 0.4) ** 2 for p in points]

    point, best = H.pattern_search(value, [0.0, 0.0], step=1.0, stop=1e-3, low=[-5, -5], high=[1.2, 5])
    assert point[0] < 1.2 and point[0] == pytest.approx(1.2, abs=5e-3) and point[1] == pytest.approx(-0.4, abs=5e-3)
    assert best == pytest.approx(-0.01, abs=1e-3) and max(asked) <= 4


def test_best_threshold_by_hand(spark):
    rows = [("a", s, y) for s, y in ((-2.0, 0), (-1.0, 0), (0.0, 0), (1.0, 0), (2.0, 1))] + [("b", s, y) for s, y in ((0.0, 0), (1.0, 1))] + [("c", 1.0, 1)]
    got = {r.g: r.threshold for r in T.best_threshold(spark.createDataFrame(rows, "g string, score double, y int"), ["g"], "y", 1, metric="Percent_correct").collect()}
    # a: 80 %, 100 %, 80 % at 0, 1, 2: the vertex is 1; b: the best is at an end; c: one score
    assert got["a"] == pytest.approx(1.0) and got["b"] == 0.0 and got["c"] == 1.0


def test_edf(spark, tmp_path):
    """A recording of two channels, one at half the rate, with annotations."""

    def field(x, width):
        return str(x).ljust(width).encode()

    names, size = ["C3", "C4", edf.ANNOTATIONS], [4, 2, 16]
    head = field(0, 8) + field("", 80) + field("", 80) + field("01.01.20", 8) + field("00.00.00", 8) + field(256 * 4, 8) + field("EDF+C", 44) + field(2, 8) + field(1, 8) + field(3, 4)
    values = {"label": names, "transducer": ["", "", ""], "dimension": ["uV", "uV", ""], "physical_min": [-100, 0, -1], "physical_max": [100, 50, 1], "digital_min": [-1000, 0, -32768], "digital_max": [1000, 1000, 32767], "prefilter": ["", "", ""], "samples": size, "reserved": ["", "", ""]}
    for name, width in edf.FIELDS:
        head += b"".join(field(x, width) for x in values[name])
    records = b""
    for k in range(2):
        notes = f"+{k}\x14\x14\x00+{k}.5\x14S 1{k}\x14\x00".encode().ljust(32, b"\x00")
        records += np.array([10 * k, 20, -30, 1000], "<i2").tobytes() + np.array([500, 1000 * k], "<i2").tobytes() + notes
    (tmp_path / "one.edf").write_bytes(head + records)
    samples, markers = edf.read_edf(spark, str(tmp_path))
    got = {(r.channel, r.t): r.value for r in samples.collect()}
    assert [got["C3", t] for t in range(8)] == pytest.approx([0, 2, -3, 100, 1, 2, -3, 100])
    assert [got["C4", t] for t in range(8)] == pytest.approx([25, 25, 0, 0, 25, 25, 50, 50])
    assert sorted((r.seconds, r.marker) for r in markers.collect()) == [(0.5, "S 10"), (1.5, "S 11")]
