"""Choosing channels: by signal to noise, by a classifier's performance without or with each, by its coefficients.

All candidates are judged from sums that are taken once: dropping a channel drops its row and column. A search is a loop
over small matrices on the driver, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.operators import learners as L
from sigmill.operators import metrics as M
from sigmill.operators.search import fold_moments, without


@dataclass
class Powers:
    """Sums of products of the channels: of the targets' evoked response, and of everything."""

    signal: np.ndarray
    all: np.ndarray

    def ssnr(self, channels: list[int], filters: int | None = None) -> float:
        """Signal over signal and noise, in the channels or under their best filters."""
        s, a = self.signal[np.ix_(channels, channels)], self.all[np.ix_(channels, channels)]
        if filters is None:
            return float(np.trace(s) / np.trace(a))
        value, base = np.linalg.eigh(a)
        white = base / np.sqrt(np.maximum(value, 1e-12 * max(value.max(), 1e-300)))
        order, rotate = np.linalg.eigh(white.T @ s @ white)
        v = white @ rotate[:, np.argsort(-order)[: min(filters, len(channels))]]
        return float(np.trace(v.T @ s @ v) / np.trace(v.T @ a @ v))


def powers(windows: DataFrame, label: str, target: str, index: str, channels: list[str]) -> Powers:
    """Two aggregates: the evoked response by sample of a window, and the products of channels over all rows."""
    evoked = windows.filter(F.col(label) == target).groupBy(index).agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in channels)).toPandas()  # a row for each sample of a window
    pairs = [(i, j) for i in range(len(channels)) for j in range(i, len(channels))]
    r = windows.agg(*(F.sum(F.col(channels[i]) * F.col(channels[j])).alias(f"{i}_{j}") for i, j in pairs)).first()
    all_ = np.array([[float(r[f"{min(i, j)}_{max(i, j)}"] or 0) for j in range(len(channels))] for i in range(len(channels))])
    a = evoked[channels].to_numpy(float).reshape(-1, len(channels))
    return Powers(a.T @ (a * evoked["n"].to_numpy(float)[:, None]), all_)


def backward_elimination(n: int, keep: int, value: Callable[[list[int]], float]) -> list[int]:
    """Removes one element after the other, always the one without which the rest is worth most (the first of equals)."""
    left = list(range(n))
    while len(left) > keep:
        worth = [value([x for x in left if x != gone]) for gone in left]
        left.remove(left[int(np.argmax(worth))])
    return left


def forward_selection(n: int, keep: int, value: Callable[[list[int]], float]) -> list[int]:
    """Adds one element after the other, always the one with which the chosen are worth most (the first of equals)."""
    chosen: list[int] = []
    while len(chosen) < keep:
        rest = [x for x in range(n) if x not in chosen]
        chosen.append(rest[int(np.argmax([value([*chosen, x]) for x in rest]))])
    return chosen


def evolutionary_search(n: int, keep: int, value: Callable[[list[int]], float], population: int = 20, survivors: int = 8, mutants: float = 0.3, crossed: float = 0.3, rounds: int = 100, seed: int = 0) -> list[int]:
    """Random subsets; the best survive; a child has one element swapped, is drawn from two parents' union, or is a copy."""
    rng = np.random.default_rng(seed)
    draw = lambda pool: sorted(rng.choice(pool, keep, replace=False).tolist())
    own, best = [draw(np.arange(n)) for _ in range(population)], None
    for _ in range(rounds):
        own = sorted(own, key=lambda x: (-value(x), x))[:survivors]
        best = own[0]
        for _ in range(population - len(own)):
            u, parent = rng.random(), own[rng.integers(min(survivors, len(own)))]
            rest = sorted(set(range(n)) - set(parent))
            if u < mutants and rest:
                child = sorted([*rng.permutation(parent)[1:].tolist(), int(rng.choice(rest))])
            elif u < mutants + crossed:
                child = draw(np.array(sorted({*parent, *own[rng.integers(min(survivors, len(own)))]})))
            else:
                child = list(parent)
            own.append(child)
    return best


def performances(df: DataFrame, fold: str, label: str, vector: str, positive: str, negative: str, subsets: list[list[int]], tau: float = 1.0) -> DataFrame:
    """subset (its number), mean: balanced accuracy over folds of a ridge classifier on each subset of the vector's entries.

    One pass of sums serves all folds and subsets; one pass scores all of them.
    """
    parts = fold_moments(df, fold, label, vector)

    def cut(m: L.Moments, own: list[int]) -> L.Moments:
        return L.Moments(m.n, {c: m.s[c][own] for c in m.s}, {c: m.q[c][np.ix_(own, own)] for c in m.q})

    def full(model: L.Linear, own: list[int], d: int) -> L.Linear:
        w = np.zeros(d)
        w[own] = model.weights
        return L.Linear(w, model.bias)

    d = len(next(iter(next(iter(parts.values())).s.values())))
    models = [(k, i, full(L.ridge_classifier(cut(without(parts, k), own), positive, negative, tau), own, d)) for k in sorted(parts) for i, own in enumerate(subsets)]
    cases = F.array(*(F.struct(F.lit(k).alias("fold"), F.lit(i).alias("subset"), m.score(vector).alias("score")) for k, i, m in models))
    each = df.select(F.col(fold).cast("string").alias("_f"), F.col(label).cast("string").alias("truth"), F.explode(cases).alias("c")).filter(F.col("_f") == F.col("c.fold"))
    scored = each.select("_f", "truth", F.col("c.subset").alias("subset"), F.when(F.col("c.score") > 0, positive).otherwise(negative).alias("predicted"))
    per = M.from_counts(M.confusion(scored, ["subset", "_f"], "truth", "predicted", positive))
    return M.average(per, ["subset"], ["Balanced_accuracy"]).select("subset", F.col("Balanced_accuracy_mean").alias("mean"))


def remove_one(d: int) -> list[list[int]]:
    """All entries but one, for each: the drop against all ranks the entry left out."""
    return [[x for x in range(d) if x != gone] for gone in range(d)]


def add_one(d: int, chosen: list[int]) -> list[list[int]]:
    """The chosen entries and one more, for each that isn't chosen."""
    return [[*chosen, x] for x in range(d) if x not in chosen]


def coefficient_ranking(model: L.Linear) -> list[int]:
    """Entries by the size of their weight, the largest first."""
    return np.argsort(-abs(model.weights), kind="stable").tolist()
