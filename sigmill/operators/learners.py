"""Classifiers and spatial filters: distributed sums of products, then small matrix work on the driver.

The sums are d x d numbers for each class, whatever the number of rows; d (features, channels) is bounded by ``MOST``.
Models are applied as column expressions, so scoring stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 1024


@dataclass
class Moments:
    """Rows, sums and sums of products by class."""

    n: dict
    s: dict
    q: dict

    def mean(self, c) -> np.ndarray:
        return self.s[c] / self.n[c]

    def scatter(self, c) -> np.ndarray:
        return self.q[c] - np.outer(self.s[c], self.s[c]) / self.n[c]

    @property
    def classes(self) -> list:
        return sorted(self.n)


def moments(df: DataFrame, label: str, vector: str) -> Moments:
    """One pass: each task adds up its own products, one row for each class and row of the matrix goes into the shuffle."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = {}, {}, {}
        for b in batches:
            for c, own in b.groupby("_label"):
                x = np.array(own["_x"].tolist(), float)
                if x.shape[1] > MOST:
                    raise ValueError(f"more than {MOST} features")
                n[c], s[c], q[c] = n.get(c, 0) + len(x), s.get(c, 0) + x.sum(0), q.get(c, 0) + x.T @ x
        for c in n:
            rows = np.vstack([s[c], q[c]])
            yield pd.DataFrame({"label": c, "row": np.arange(len(rows)), "n": n[c], "x": list(rows)})

    some = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("_label"), F.col(vector).cast("array<double>").alias("_x"))
    parts = some.mapInPandas(add, "label string, row long, n long, x array<double>")
    long = parts.select("label", "row", "n", F.posexplode("x").alias("col", "v"))
    sums = long.groupBy("label", "row", "col").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = sums.toPandas()  # classes x (d + 1) x d numbers
    out = Moments({}, {}, {})
    for c, own in got.groupby("label"):
        m = own.pivot(index="row", columns="col", values="v").to_numpy()
        out.n[c], out.s[c], out.q[c] = int(own["n"].iloc[0]), m[0], m[1:]
    return out


def dot(vector: str | Column, weights: np.ndarray, bias: float = 0.0) -> Column:
    w = F.array(*(F.lit(float(x)) for x in weights))
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.aggregate(F.zip_with(v.cast("array<double>"), w, lambda a, b: a * b), F.lit(float(bias)), lambda s, x: s + x)


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def score(self, vector: str) -> Column:
        return dot(vector, self.weights, self.bias)


def lda(m: Moments, positive: str, negative: str, ridge: float = 1e-6) -> Linear:
    """Pooled covariance; a positive score means the first class, with the prior's log odds in the bias."""
    n = m.n[positive] + m.n[negative]
    cov = (m.scatter(positive) + m.scatter(negative)) / n
    cov += ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
    a, b = m.mean(positive), m.mean(negative)
    w = np.linalg.solve(cov, a - b)
    return Linear(w, float(-(a + b) @ w / 2 + np.log(m.n[positive] / m.n[negative])))


@dataclass
class Quadratic:
    a: np.ndarray
    w: np.ndarray
    bias: float

    def score(self, vector: str) -> Column:
        """x'Ax + w'x + bias, by rows of A, which is one literal: the plan doesn't grow with the number of features."""
        rows = F.expr("array(" + ",".join("array(" + ",".join(f"{float(x)!r}D" for x in r) + ")" for r in self.a) + ")")
        v = F.col(vector).cast("array<double>")
        total = lambda products: F.aggregate(products, F.lit(0.0), lambda s, x: s + x)
        quad = total(F.zip_with(v, rows, lambda x, r: x * total(F.zip_with(v, r, lambda a, b: a * b))))
        return quad + dot(vector, self.w, self.bias)


def qda(m: Moments, positive: str, negative: str, ridge: float = 1e-3) -> Quadratic:
    """Log ratio of two Gaussians with covariances of their own; positive means the first class."""

    def parts(c):
        cov = m.scatter(c) / m.n[c]
        cov += ridge * np.trace(cov) / len(cov) * np.eye(len(cov))
        inv, mu = np.linalg.inv(cov), m.mean(c)
        return inv, inv @ mu, mu @ inv @ mu + np.linalg.slogdet(cov)[1] - 2 * np.log(m.n[c])

    (pa, pb, pc), (na, nb, nc) = parts(positive), parts(negative)
    return Quadratic((na - pa) / 2, pb - nb, (nc - pc) / 2)


def nearest_mean(m: Moments, positive: str, negative: str) -> Linear:
    """Which of two classes' means is nearer."""
    a, b = m.mean(positive), m.mean(negative)
    return Linear(a - b, float(b @ b - a @ a) / 2)


def one_against_one(m: Moments, fit=lda, classes: list[str] | None = None) -> dict[tuple[str, str], Linear]:
    """A two-class machine for each pair of classes, all from the sums of one pass: fit(moments, first, second)."""
    classes = m.classes if classes is None else classes
    return {(a, b): fit(m, a, b) for k, a in enumerate(classes) for b in classes[k + 1 :]}


def one_against_rest(m: Moments, fit=lda, classes: list[str] | None = None) -> dict[str, Linear]:
    """A machine for each class against all others together."""
    out = {}
    for c in m.classes if classes is None else classes:
        rest = [x for x in m.classes if x != c]
        two = Moments({c: m.n[c], "rest": sum(m.n[x] for x in rest)}, {c: m.s[c], "rest": sum(m.s[x] for x in rest)}, {c: m.q[c], "rest": sum(m.q[x] for x in rest)})
        out[c] = fit(two, c, "rest")
    return out


def vote_of_pairs(df: DataFrame, models: dict[tuple[str, str], Linear], vector: str, label: str = "predicted", votes: str = "votes") -> DataFrame:
    """The class with most pairs won, and how many; ties go to the larger sum of scores (of a pair to its first class, less
    from its second), then to the smaller class. The scores of all pairs are one array."""
    classes = sorted({c for pair in models for c in pair})
    scores = F.array(*(m.score(vector) for m in models.values()))
    pairs = list(models)

    def standing(c: str, s: Column) -> Column:
        won = sum(((s[k] > 0) if a == c else (s[k] <= 0)).cast("int") for k, (a, b) in enumerate(pairs) if c in (a, b))
        total = sum(s[k] if a == c else -s[k] for k, (a, b) in enumerate(pairs) if c in (a, b))
        return F.struct(won.alias("votes"), total.alias("total"), F.lit(-classes.index(c)).alias("order"), F.lit(c).alias("class"))

    scored = df.withColumn("_s", scores)
    best = F.array_max(F.array(*(standing(c, F.col("_s")) for c in classes)))
    return scored.withColumn("_b", best).withColumns({label: F.col("_b.class"), votes: F.col("_b.votes")}).drop("_s", "_b")


def ridge_classifier(m: Moments, positive: str, negative: str, tau: float = 1.0) -> Linear:
    """Least squares on +-1 with an unpenalised offset."""
    n = m.n[positive] + m.n[negative]
    s, q = m.s[positive] + m.s[negative], m.q[positive] + m.q[negative]
    t, xt = m.n[positive] - m.n[negative], m.s[positive] - m.s[negative]
    w = np.linalg.solve(q - np.outer(s, s) / n + tau * np.eye(len(s)), xt - s * t / n)
    return Linear(w, float((t - s @ w) / n))


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive: the sign that an eigenvector leaves open."""
    top = np.argmax(abs(vectors), 0)
    return vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def pca(m: Moments, k: int) -> np.ndarray:
    n, s, q = sum(m.n.values()), sum(m.s.values()), sum(m.q.values())
    value, vector = np.linalg.eigh(q / n - np.outer(s / n, s / n))
    return _signed(vector[:, np.argsort(-value)[:k]])


def csp(m: Moments, first: str, k: int) -> np.ndarray:
    """Filters of the generalised eigenproblem of one class's mean product against the sum, taken from both ends in turn."""
    c = {x: m.q[x] / m.n[x] for x in m.classes}
    whole = sum(c.values())
    value, base = np.linalg.eigh(whole)
    white = base / np.sqrt(np.maximum(value, 1e-12))
    order, rotate = np.linalg.eigh(white.T @ c[first] @ white)
    filters = white @ rotate[:, np.argsort(-order)]
    pick = [x for i in range((k + 1) // 2) for x in (i, filters.shape[1] - 1 - i)][: k - k % 2]
    return _signed(filters[:, pick])


def fda(m: Moments, k: int) -> np.ndarray:
    """Fisher's directions: between-class against within-class scatter."""
    n = sum(m.n.values())
    mean = sum(m.s.values()) / n
    within = sum(m.scatter(c) for c in m.classes) / n
    within += 1e-6 * np.trace(within) / len(within) * np.eye(len(within))
    between = sum(m.n[c] * np.outer(m.mean(c) - mean, m.mean(c) - mean) for c in m.classes) / n
    value, vector = np.linalg.eig(np.linalg.solve(within, between))
    return _signed(np.real(vector[:, np.argsort(-np.real(value))[:k]]))


def project(df: DataFrame, vector: str, filters: np.ndarray, name: str = "projected") -> DataFrame:
    return df.withColumn(name, F.array(*(dot(vector, f) for f in filters.T)))


@contextmanager
def kept(df: DataFrame) -> Iterator[None]:
    """Rows that several rounds read stay with the executors for so long: beyond memory they are on disk, and those of a
    lost executor are read again from the source."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield
    finally:
        df.unpersist()


def svm(df: DataFrame, label: str, vector: str, positive: str, complexity: float = 1.0, rounds: int = 60) -> Linear:
    """Soft-margin linear machine with squared hinge loss by Newton steps on distributed sums.

    The machine of ``margins.relative_margin`` without an outer margin, with the offset as part of the objective.
    """
    from sigmill.operators import margins

    rows = df.select(F.when(F.col(label).cast("string") == positive, 1.0).otherwise(-1.0).alias("y"), F.col(vector).cast("array<double>").alias("x"))
    return margins.relative_margin(rows, "y", "x", complexity, float("inf"), rounds=rounds, bias_penalty=1.0)


def ica(df: DataFrame, vector: str, k: int, rounds: int = 40, seed: int = 0) -> np.ndarray:
    """Independent components (columns are filters) by the symmetric fixed-point rule with tanh.

    Whitening comes from one pass of moments; each round is one pass in which every task adds up k x k numbers. The
    executors keep the vectors meanwhile.
    """
    rows = df.select(F.lit("all").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    with kept(rows):
        return _fixed_point(rows, k, rounds, seed)


def _fixed_point(rows: DataFrame, k: int, rounds: int, seed: int) -> np.ndarray:
    m = moments(rows, "label", "x")
    n, mean = m.n["all"], m.mean("all")
    value, base = np.linalg.eigh(m.scatter("all") / n)
    order = np.argsort(-value)[:k]
    white = base[:, order] / np.sqrt(np.maximum(value[order], 1e-12))
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    for _ in range(rounds):

        def add(batches, w=w):
            s, d = np.zeros((k, k)), np.zeros(k)
            for b in batches:
                z = (np.array(b["x"].tolist(), float).reshape(len(b), -1) - mean) @ white
                g = np.tanh(z @ w)
                s += z.T @ g
                d += (1 - g * g).sum(0)
            yield pd.DataFrame({"row": np.arange(k + 1), "v": list(np.vstack([s, d]))})

        sums = rows.mapInPandas(add, "row long, v array<double>").select("row", F.posexplode("v").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).toPandas()
        t = sums.pivot(index="row", columns="col", values="v").to_numpy() / n
        u, _, v = np.linalg.svd(t[:k] - w * t[k])
        moved = np.max(1 - abs(np.sum((u @ v) * w, 0)))
        w = u @ v
        if moved < 1e-7:
            break
    return _signed(white @ w)
