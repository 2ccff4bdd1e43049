"""Searches over parameters and combinations of filters, from sums that are taken once.

Sums of products add up over folds. One pass by fold gives every training set of a cross-validation by subtraction, and
every regularisation by a small solve, so a grid costs one pass over the data and one scoring pass with all models.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmill.operators import learners as L
from sigmill.operators import metrics as M
from sigmill.operators.generators import mixed


def fold_moments(df: DataFrame, fold: str, label: str, vector: str) -> dict[str, L.Moments]:
    """Moments of each fold's rows."""
    both = L.moments(df.withColumn("_both", F.concat_ws("\t", F.col(fold).cast("string"), F.col(label).cast("string"))), "_both", vector)
    out: dict[str, L.Moments] = {}
    for c in both.n:
        k, name = c.split("\t", 1)
        own = out.setdefault(k, L.Moments({}, {}, {}))
        own.n[name], own.s[name], own.q[name] = both.n[c], both.s[c], both.q[c]
    return out


def without(parts: dict[str, L.Moments], fold: str) -> L.Moments:
    """Moments of all folds but one."""
    out = L.Moments({}, {}, {})
    for k, m in parts.items():
        if k != fold:
            for c in m.n:
                out.n[c], out.s[c], out.q[c] = out.n.get(c, 0) + m.n[c], out.s.get(c, 0) + m.s[c], out.q.get(c, 0) + m.q[c]
    return out


def grid(df: DataFrame, fold: str, label: str, vector: str, positive: str, negative: str, taus: list[float]) -> DataFrame:
    """Balanced accuracy by tau: mean and deviation over folds, and which is best (the first of equals)."""
    parts = fold_moments(df, fold, label, vector)
    models = [(k, tau, L.ridge_classifier(without(parts, k), positive, negative, tau)) for k in sorted(parts) for tau in taus]
    cases = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(float(tau)).alias("tau"), m.score(vector).alias("score")) for k, tau, m in models))
    each = df.select(F.col(fold).cast("string").alias("_f"), F.col(label).cast("string").alias("truth"), F.explode(cases).alias("c")).filter(F.col("_f") == F.col("c.fold"))
    scored = each.select("_f", "truth", F.col("c.tau").alias("tau"), F.when(F.col("c.score") > 0, positive).otherwise(negative).alias("predicted"))
    per = M.from_counts(M.confusion(scored, ["tau", "_f"], "truth", "predicted", positive))
    out = M.average(per, ["tau"], ["Balanced_accuracy"])
    best = out.agg(F.max(F.struct("Balanced_accuracy_mean", (-F.col("tau")).alias("t")))["t"].alias("_t"))
    return out.crossJoin(F.broadcast(best)).withColumn("best", F.col("tau") == -F.col("_t")).drop("_t")


@dataclass
class Found:
    """A search's table (parameters, mean, std, objective, best), the best parameters and the model refitted with them."""

    table: DataFrame
    best: dict
    model: object


def parameter_search(df: DataFrame, fold: str, label: str, vector: str, positive: str, negative: str, fit: Callable[..., L.Linear], grid: dict[str, list], metric: str = "Balanced_accuracy", std_weight: float = 0.0, inverse: bool = False, each: list[str] = ()) -> Found:
    """Exhaustive search over any number of parameters; fit(moments, positive, negative, **parameters).

    The objective of a setting is the metric's mean over folds less std_weight times its deviation (of the negated metric,
    if inverse: for errors); the first in the grid's order of equal ones is best. All settings of all folds are fitted from
    one pass of sums, and scored together in another. each: parameters for which the best of every value is marked, as a
    search of its own; the best of all is refitted on all rows.
    """
    names = list(grid)
    settings = list(product(*grid.values()))
    parts = fold_moments(df, fold, label, vector)
    models = [(k, i, fit(without(parts, k), positive, negative, **dict(zip(names, v)))) for k in sorted(parts) for i, v in enumerate(settings)]
    by_fold = [F.when(F.col("_f") == k, F.array(*(m.score(vector) for f, _, m in models if f == k))) for k in sorted(parts)]
    scored = df.withColumn("_f", F.col(fold).cast("string")).select("_f", F.col(label).cast("string").alias("truth"), F.posexplode(F.coalesce(*by_fold)).alias("setting", "score"))
    decided = scored.withColumn("predicted", F.when(F.col("score") > 0, positive).otherwise(negative))
    per = M.from_counts(M.confusion(decided, ["setting", "_f"], "truth", "predicted", positive))
    stats = M.average(per, ["setting"], [metric]).select("setting", F.col(f"{metric}_mean").alias("mean"), F.col(f"{metric}_std").alias("std"))
    stats = stats.withColumn("objective", (-1.0 if inverse else 1.0) * F.col("mean") - std_weight * F.col("std"))
    of = df.sparkSession.createDataFrame([(i, *v) for i, v in enumerate(settings)], ["setting", *names]).withColumn("setting", F.col("setting").cast("int"))
    w = Window.partitionBy(*each).orderBy(F.desc("objective"), "setting")  # a row for each setting
    table = of.join(stats, "setting").withColumn("best", F.row_number().over(w) == 1)
    top = table.orderBy(F.desc("objective"), "setting").first()
    best = dict(zip(names, settings[top["setting"]]))
    return Found(table.drop("setting"), best, fit(without(parts, ""), positive, negative, **best))


def bayesian_lda(m: L.Moments, positive: str, negative: str, rounds: int = 500, stop: float = 1e-4) -> L.Linear:
    """Regression on class targets with precisions of weights (alpha) and noise (beta) by evidence maximisation."""
    n1, n0 = m.n[positive], m.n[negative]
    n = n1 + n0
    t1, t0 = n / n1, -n / n0
    s, q = m.s[positive] + m.s[negative], m.q[positive] + m.q[negative]
    d = len(s)
    big = np.zeros((d + 1, d + 1))
    big[:d, :d], big[:d, d], big[d, :d], big[d, d] = q, s, s, n
    xt = np.append(t1 * m.s[positive] + t0 * m.s[negative], t1 * n1 + t0 * n0)
    tt = t1 * t1 * n1 + t0 * t0 * n0
    value, vector = np.linalg.eigh(big)
    p = vector.T @ xt
    alpha, beta = 25.0, 1.0
    for _ in range(rounds):
        w = beta * p / (beta * value + alpha)
        gamma = float((beta * value / (beta * value + alpha)).sum())
        error = max(float(tt - 2 * w @ p + w @ (value * w)), 1e-12)
        new = gamma / max(float(w @ w), 1e-12), max(n - gamma, 1e-9) / error
        done = abs(new[0] - alpha) <= stop * alpha and abs(new[1] - beta) <= stop * beta
        alpha, beta = new
        if done:
            break
    w = vector @ (beta * p / (beta * value + alpha))
    return L.Linear(w[:-1], float(w[-1]))


def xdawn(windows: DataFrame, label: str, target: str, index: str, channels: list[str], k: int) -> np.ndarray:
    """Filters (columns) that maximise the power of the target's evoked response against all power.

    For windows that don't overlap the response is the targets' mean window, so two aggregates of channel columns suffice.
    """
    signal, power = response_power(windows, label, target, index, channels)
    value, base = np.linalg.eigh(power)
    white = base / np.sqrt(np.maximum(value, 1e-12 * max(value.max(), 1e-300)))
    order, rotate = np.linalg.eigh(white.T @ signal @ white)
    return L._signed(white @ rotate[:, np.argsort(-order)[:k]])


def response_power(windows: DataFrame, label: str, target: str, index: str, channels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of products of the channels: of the target's evoked response, and of all rows."""
    evoked = windows.filter(F.col(label) == target).groupBy(index).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in channels)).toPandas()  # a row for each sample of a window
    r = windows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(channels) for j, b in enumerate(channels) if j >= i)).first()
    power = np.array([[r[f"{min(i, j)}_{max(i, j)}"] for j in range(len(channels))] for i in range(len(channels))], float)
    a = evoked[channels].to_numpy()
    return a.T @ (a * evoked["n"].to_numpy()[:, None]), power


def sparse_filter(signal: np.ndarray, power: np.ndarray, keep: int, weight: float) -> tuple[list[int], np.ndarray]:
    """The channels of a sparse xDAWN filter, and the filter over them (unit length).

    It maximises signal / power of the filtered channels less weight times the filter's sum of magnitudes over its length,
    by pattern search from the plain filter and from each single channel; then the largest ``keep`` weights stay.
    """
    value, base = np.linalg.eigh(power)
    white = base / np.sqrt(np.maximum(value, 1e-12 * max(value.max(), 1e-300)))
    plain = white @ np.linalg.eigh(white.T @ signal @ white)[1][:, -1]

    def objective(points: list[list[float]]) -> list[float]:
        v = np.array(points)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        ratio = np.einsum("ni,ij,nj->n", v, signal, v) / np.maximum(np.einsum("ni,ij,nj->n", v, power, v), 1e-300)
        return list(ratio - weight * np.abs(v).sum(1))

    starts = [list(plain / np.linalg.norm(plain)), *np.eye(len(power)).tolist()]
    best, _ = max((pattern_search(objective, s, 0.5, 1e-6) for s in starts), key=lambda x: x[1])
    v = np.array(best) / np.linalg.norm(best)
    chosen = sorted(np.argsort(-np.abs(v), kind="stable")[:keep].tolist())
    v = v[chosen]
    return chosen, L._signed((v / np.linalg.norm(v))[:, None])[:, 0]


def pattern_search(value: Callable[[list[list[float]]], list[float]], start: list[float], step: float = 1.0, stop: float = 1e-10, low: list[float] | None = None, high: list[float] | None = None, shrink: float = 0.5, grow: float = 1.0, rounds: int = 10_000) -> tuple[list[float], float]:
    """The best point and its value. Each round polls a step along every axis, both ways and strictly inside the bounds, as
    one call of value, so one job judges the whole poll set; points are judged once. A better point is moved to (and the
    step grows), else the step shrinks, until it is below stop."""
    known: dict[tuple, float] = {}

    def judge(points: list[tuple]) -> None:
        new = [p for p in dict.fromkeys(points) if p not in known]
        if new:
            known.update(zip(new, value([list(p) for p in new])))

    at = tuple(start)
    judge([at])
    for _ in range(rounds):
        if step < stop:
            break
        moved = [tuple(x + d * step * (k == axis) for k, x in enumerate(at)) for axis in range(len(at)) for d in (1, -1)]
        inside = [p for p in moved if all((low is None or a < x) and (high is None or x < b) for x, a, b in zip(p, low or p, high or p))]
        judge(inside)
        best = max(inside, key=known.__getitem__, default=at)
        at, step = (best, step * grow) if known[best] > known[at] else (at, step * shrink)
    return list(at), known[at]


def random_projection(df: DataFrame, row: str, feature: str, value: str, k: int, seed: int = 0) -> DataFrame:
    """Features (numbered, or by name) compressed to k sums with Gaussian weights, which (feature, target, seed) fix."""
    f = F.col(feature) if isinstance(df.schema[feature].dataType, T.IntegralType) else F.crc32(F.col(feature).cast("string").cast("binary"))
    unit = lambda salt, j: (mixed(mixed(f) + 2 * (seed * k + j) + salt) + 0.5) / float(1 << 32)
    weight = lambda j: F.sqrt(-2 * F.log(unit(0, j))) * F.cos(2 * np.pi * unit(1, j))
    return df.groupBy(row).agg(*(F.sum(F.col(value) * weight(j)).alias(f"p{j}") for j in range(k)))


def ssnr(windows: DataFrame, label: str, target: str, index: str, channels: list[str], filters: np.ndarray | None = None) -> float:
    """Signal to signal-plus-noise ratio: power of the targets' evoked response over all power, under the filters if given."""
    signal, power = response_power(windows, label, target, index, channels)
    v = np.eye(len(channels)) if filters is None else filters
    return float(np.trace(v.T @ signal @ v) / np.trace(v.T @ power @ v))
