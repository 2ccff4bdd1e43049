"""Linear machines with margins, fitted by Newton steps whose sums are one pass over stored vectors each.

Losses are squared, so each step solves a linear system of the rows that break a margin at the time. Besides the two-class
machine with an outer margin there are one-class machines and a regression; all are the same step with other targets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigmill.operators.learners import MOST, Linear, kept

#: Numbers that differences from landmarks take at once.
SLICE = 1 << 20


def values(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch as a matrix, from the flat buffer of the list column."""
    at = np.asarray(column.offsets)
    flat = np.asarray(column.values.slice(at[0], at[-1] - at[0]), float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def newton_sums(df: DataFrame, target: str, vector: str, step, losses: int = 1) -> tuple[np.ndarray, np.ndarray, float | np.ndarray]:
    """Sums over rows of h [x, 1][x, 1]', of g [x, 1] and of the loss, where step(f-free targets, x) gives (g, h, loss); of
    several losses, if they are the columns of a matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = values(b.column("_x"))
            if x.shape[1] > MOST:
                raise ValueError(f"more than {MOST} features")
            x = np.hstack([x, np.ones((len(x), 1))])
            g, h, loss = step(np.asarray(b.column("_y"), float), x)
            own = np.zeros((x.shape[1] + 2, max(x.shape[1], losses)))
            own[:-2, : x.shape[1]], own[-2, : x.shape[1]], own[-1, :losses] = (x * h[:, None]).T @ x, g @ x, loss.sum(0)
            total = own if total is None else total + own
        if total is not None:
            n = pa.array(range(len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([n, pa.array(total.tolist(), pa.list_(pa.float64()))], names=["row", "v"])

    parts = df.select(F.col(target).cast("double").alias("_y"), F.col(vector).cast("array<double>").alias("_x")).mapInArrow(add, "row int, v array<double>")
    cells = parts.select("row", F.posexplode("v").alias("k", "v")).groupBy("row", "k").agg(F.sum("v").alias("v")).toPandas()  # (d + 3) x (d + 1) numbers
    m = cells.pivot(index="row", columns="k", values="v").to_numpy()
    d = len(m) - 2
    return m[:-2, :d], m[-2, :d], float(m[-1, 0]) if losses == 1 else m[-1, :losses]


def fit(df: DataFrame, target: str, vector: str, step, fixed_bias: float | None = None, rounds: int = 60, stop: float = 1e-8, bias_penalty: float = 0.0) -> Linear:
    """Minimises |w|^2 / 2 + bias_penalty b^2 / 2 + the sum of losses; step(w) gives the row-wise function of newton_sums.
    Steps are halved while they raise the objective. The executors keep the rows meanwhile."""
    with kept(rows := df.select(target, vector)):
        return _minimum(rows, target, vector, step, fixed_bias, rounds, stop, bias_penalty)


def _minimum(df: DataFrame, target: str, vector: str, step, fixed_bias: float | None, rounds: int, stop: float, bias_penalty: float) -> Linear:
    first = df.select(F.size(vector).alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    w = np.zeros(first["n"] + 1)
    free = np.arange(len(w) - (fixed_bias is not None))
    if fixed_bias is not None:
        w[-1] = fixed_bias
    penalty = np.append(np.ones(len(w) - 1), bias_penalty)
    a, g, loss = newton_sums(df, target, vector, step(w))
    for _ in range(rounds):
        value = penalty @ (w * w) / 2 + loss
        move = np.linalg.solve(a[np.ix_(free, free)] + np.diag(penalty[free] + 1e-9), (g + penalty * w)[free])
        size = 1.0
        while True:
            new = w.copy()
            new[free] -= size * move
            a, g, loss = newton_sums(df, target, vector, step(new))
            if penalty @ (new * new) / 2 + loss <= value or size < 1e-6:
                break
            size /= 2
        done = np.abs(new - w).max() <= stop * max(1.0, np.abs(w).max())
        w = new
        if done:
            break
    return Linear(w[:-1], float(w[-1]))


def relative_margin(df: DataFrame, target: str, vector: str, complexity: float = 1.0, outer: float = 2.0, outer_complexity: float | None = None, fixed_bias: float | None = None, **options) -> Linear:
    """Balanced relative margin machine, targets +-1: y f at least 1, and at most ``outer``. Without an outer margin
    (infinite) it is the support vector machine; with one near 1 it is a regression on the labels."""
    outer_complexity = complexity if outer_complexity is None else outer_complexity

    def step(w: np.ndarray):
        def sums(y, x):
            m = y * (x @ w)
            low, high = np.maximum(1 - m, 0), np.maximum(m - outer, 0)
            return 2 * y * (outer_complexity * high - complexity * low), 2 * (complexity * (low > 0) + outer_complexity * (high > 0)), complexity * low**2 + outer_complexity * high**2

        return sums

    return fit(df, target, vector, step, fixed_bias, **options)


def one_class(df: DataFrame, vector: str, complexity: float = 1.0, outer: float = 2.0, **options) -> Linear:
    """One-class relative margin machine: all rows are positive, the offset is fixed at -1, f + 1 is their margin."""
    return relative_margin(df.withColumn("_one", F.lit(1.0)), "_one", vector, complexity, outer + 1, fixed_bias=-1.0, **options)


def _hinge(over: np.ndarray, price: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """min over slacks s of price s - width log s - width log(s - over), and its first two derivatives by over."""
    a = price * over
    root = np.sqrt(a * a + 4 * width * width)
    rest = 4 * width * width / (root + np.abs(a))  # root - |a| without loss of digits
    s, beyond = (2 * width + np.where(a > 0, root + a, rest)) / (2 * price), (2 * width + np.where(a > 0, rest, root - a)) / (2 * price)
    return price * s - width * np.log(s) - width * np.log(beyond), width / beyond, width / (s * s + beyond * beyond)


@dataclass
class Absolute(Linear):
    """The machine with what certifies it: its objective, a lower bound of every machine's, and how many passes it took."""

    objective: float
    bound: float
    passes: int


def absolute_margin(df: DataFrame, target: str, vector: str, complexity: float = 1.0, outer: float = 2.0, outer_complexity: float | None = None, weights: tuple[float, float] = (1.0, 1.0), tolerance: float = 1e-6, passes: int = 400) -> Absolute:
    """Relative margin machine with absolute values: the linear program min |w|_1 + sum c (1 - m)+ + sum c' (m - outer)+ over
    the margins m = y (w x + b), targets +-1. outer infinite: the 1-norm support vector machine. weights: factors of the
    complexities of the negative and the positive class.

    Solved along the central path: the slacks of every row and weight have a logarithmic barrier and closed forms, so a row
    needs no state, and a Newton step is one pass of sums (d x d numbers); no program of the size of the data is ever made.
    The barrier's slopes are a point of the dual program; the distance of the two objectives bounds the error, and the path
    ends where it is at most tolerance of the objective."""
    outer_complexity = complexity if outer_complexity is None else outer_complexity
    with kept(rows := df.select(target, vector).filter(F.col(target).isNotNull() & F.col(vector).isNotNull())):
        first = rows.select(F.size(vector).alias("n")).first()
        if first is None:
            raise ValueError("no rows to learn from")
        w, taken, width = np.zeros(first["n"] + 1), 0, 1.0

        def at(w: np.ndarray, width: float):
            def sums(y, x):
                c = np.where(y > 0, weights[1], weights[0])
                m = y * (x @ w)
                sides = [(1 - m, c * complexity, -1.0, 1.0)] + [(m - outer, c * outer_complexity, 1.0, -outer)] * bool(np.isfinite(outer))
                grad, curve, loss = 0.0, 0.0, np.zeros((len(y), 4))
                for over, price, way, at_bound in sides:
                    value, slope, bend = _hinge(over, price, width)
                    grad, curve = grad + way * slope, curve + bend
                    loss += np.stack([value, price * np.maximum(over, 0), slope * at_bound, np.full(len(y), 2.0)], 1)
                return y * grad, curve, loss

            h, g, (smooth, primal, dual, terms) = newton_sums(rows, target, vector, sums, 4)
            root = np.sqrt(width**2 + w[:-1] ** 2)
            u = width + root
            value = smooth + float((u - width * np.log(2 * width * u)).sum())
            grad = g + np.append(w[:-1] / u, 0.0)
            curve = h + np.diag(np.append(width / (root * u), 0.0))
            scale = 1 / max(1.0, float(np.abs(g[:-1]).max()))
            top = primal + float(np.abs(w[:-1]).sum())
            return value, grad, curve, top, scale * dual - abs(w[-1] * g[-1]), (terms + 2 * len(g)) * width

        value, grad, curve, top, bound, gap = at(w, width)
        best = (top, w)
        while taken < passes:
            near = gap <= tolerance * top / 2  # of the path itself: what is left is to come close to it
            settled = False
            while not settled and taken < passes:
                move = np.linalg.solve(curve + 1e-14 * np.trace(curve) * np.eye(len(w)), grad)
                decrease, size = float(grad @ move), 1.0
                while True:
                    new = w - size * move
                    got = at(new, width)
                    taken += 1
                    if got[0] <= value - 1e-4 * size * decrease + 1e-12 * abs(value) or size < 1e-4:
                        break
                    size /= 2
                w, (value, grad, curve, top, lower, gap) = new, got
                bound, best = max(bound, lower), min(best, (top, w), key=lambda x: x[0])
                if best[0] - bound <= tolerance * max(best[0], 1e-12):
                    return Absolute(best[1][:-1], float(best[1][-1]), best[0], bound, taken)
                settled = decrease <= (1e-12 if near else 0.3) * width or size < 1e-4
            width /= 10
            value, grad, curve, top, lower, gap = at(w, width)
            taken += 1
        return Absolute(best[1][:-1], float(best[1][-1]), best[0], bound, taken)


def regression(df: DataFrame, target: str, vector: str, complexity: float = 1.0, epsilon: float = 0.1, **options) -> Linear:
    """Support vector regression with squared loss beyond epsilon."""

    def step(w: np.ndarray):
        def sums(y, x):
            r = x @ w - y
            over = np.sign(r) * np.maximum(np.abs(r) - epsilon, 0)
            return 2 * complexity * over, 2 * complexity * (over != 0).astype(float), complexity * over**2

        return sums

    return fit(df, target, vector, step, **options)


def margin_by_regression(df: DataFrame, target: str, vector: str, complexity: float = 1.0, outer: float = 3.0, **options) -> Linear:
    """The balanced relative margin machine by way of a regression on the labels: 1 <= y f <= outer is |f' - y| <= epsilon
    with epsilon = (outer - 1) / (outer + 1) and f = f' (outer + 1) / 2. With squared losses the complexity stays."""
    half = (outer + 1) / 2
    model = regression(df, target, vector, complexity, (outer - 1) / (outer + 1), **options)
    return Linear(model.weights * half, model.bias * half)


@dataclass
class KernelMachine:
    """Landmarks, the map that makes their kernel values features, and a linear machine on these."""

    landmarks: np.ndarray
    white: np.ndarray
    kernel: str
    width: float
    machine: Linear

    def features(self, df: DataFrame, vector: str, name: str = "mapped") -> DataFrame:
        return mapped(df, vector, self.landmarks, self.white, self.kernel, self.width, name)

    def score(self, df: DataFrame, vector: str, name: str = "score") -> DataFrame:
        """df with the machine's score."""
        return self.features(df, vector, "_mapped").withColumn(name, self.machine.score("_mapped")).drop("_mapped")


def kernel_values(a: np.ndarray, b: np.ndarray, kernel: str, width: float) -> np.ndarray:
    """rbf: exp(-width |a - b|^2); poly: (a b + 1)^width; linear: a b."""
    if kernel == "rbf":
        return np.exp(-width * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))
    return (a @ b.T + 1) ** width if kernel == "poly" else a @ b.T


def mapped(df: DataFrame, vector: str, landmarks: np.ndarray, white: np.ndarray, kernel: str, width: float, name: str) -> DataFrame:
    """df with the array of features whose inner products are the kernel's, as far as the landmarks span it."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(vector)
            some = np.flatnonzero(np.asarray(column.is_valid()))
            out = kernel_values(values(column.take(pa.array(some)).cast(pa.list_(pa.float64()))), landmarks, kernel, width) @ white if len(some) else np.zeros((0, white.shape[1]))
            at = np.zeros(b.num_rows + 1, np.int32)
            at[some + 1] = white.shape[1]
            own = pa.ListArray.from_arrays(pa.array(np.cumsum(at), pa.int32()), pa.array(out.ravel()), mask=column.is_null())
            yield pa.RecordBatch.from_arrays([*b.columns, own], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def nearest(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Squared distance of each row from the nearest of those held, by slices of rows: the differences of a whole batch with
    all of them would be hundreds of MB."""
    step = max(1, SLICE // max(1, held.size))
    return np.concatenate([np.zeros(0), *(((x[k : k + step, None] - held[None]) ** 2).sum(2).min(1) for k in range(0, len(x), step))])


def landmarks(df: DataFrame, vector: str, count: int, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """Rows that lie far apart: each round takes its share of rows, drawn with weights of their squared distance from those
    taken so far, by one pass. A draw is the ``share`` smallest of exponential times over weights, so only these reach the
    driver, and no row is drawn twice."""
    rows = df.select(F.col(vector).cast("array<double>").alias("x")).filter(F.col("x").isNotNull())
    share = -(-count // rounds)
    unit = lambda salt: (F.pmod(F.xxhash64("x", F.lit(seed), F.lit(salt)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    found = np.zeros((0, 0))
    with kept(rows):
        for r in range(rounds):
            held = found

            def far(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    x = values(b.column("x"))
                    d = nearest(x, held) if len(held) else np.ones(len(x))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d)], names=["x", "u", "d"])

            drawn = rows.withColumn("u", unit(r)).distinct().mapInArrow(far, "x array<double>, u double, d double").filter("d > 1e-12")
            more = drawn.orderBy(-F.log("u") / F.col("d"), "x").limit(min(share, count - len(found))).select("x").toArrow()
            if not more.num_rows:
                break
            more = np.array(more["x"].to_pylist())
            found = np.vstack([found, more]) if len(found) else more
    return found


def kernel_machine(df: DataFrame, target: str, vector: str, complexity: float = 1.0, kernel: str = "rbf", width: float = 1.0, count: int = 256, seed: int = 0) -> KernelMachine:
    """Support vector machine with squared hinge loss and a kernel, the offset in the objective, targets +-1.

    The kernel's features are those of ``count`` landmarks (all distinct rows, if there are no more: the machine is then the
    exact one), and the linear machine's Newton steps are one pass of sums each. No kernel matrix of rows is made."""
    marks = landmarks(df, vector, count, seed=seed)
    if not len(marks):
        raise ValueError("no rows to learn from")
    value, base = np.linalg.eigh(kernel_values(marks, marks, kernel, width))
    some = value > 1e-10 * value.max()
    white = base[:, some] / np.sqrt(value[some])
    rows = mapped(df.select(target, F.col(vector).cast("array<double>").alias("_v")), "_v", marks, white, kernel, width, "_mapped")
    machine = relative_margin(rows, target, "_mapped", complexity, float("inf"), bias_penalty=1.0)
    return KernelMachine(marks, white, kernel, width, machine)


@dataclass
class Ball:
    """A centre and a radius; the score is the distance beyond the radius, so positive is outside."""

    centre: np.ndarray
    radius: float

    def score(self, vector: str) -> Column:
        return distance(vector, self.centre) - self.radius


def distance(vector: str, centre: np.ndarray) -> Column:
    c = F.expr("array(" + ",".join(f"{float(x)!r}D" for x in centre) + ")")
    d = F.zip_with(F.col(vector).cast("array<double>"), c, lambda a, b: (a - b) * (a - b))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x))


def data_description(df: DataFrame, vector: str, radius: float, slack: float | None = None, rounds: int = 100, stop: float = 1e-9) -> Ball:
    """Centre of a ball of a given radius with the least loss of the rows beyond it.

    The batch form of the passive-aggressive updates: all rows' steps at one centre are taken together. slack None: the
    loss itself is the step; else it is at most slack (the bounded form). The loss is convex, and each round moves the
    centre by the mean step of the rows outside (a weighted mean of rows), until it rests.
    """
    n = df.select(F.size(vector).alias("n")).first()["n"]
    start = df.select(F.posexplode(vector).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("v")).toPandas().sort_values("k")
    centre = start["v"].to_numpy(float)
    entry = lambda k: F.col(vector)[k].cast("double")
    for _ in range(rounds):
        d = F.col("_d")
        loss = F.greatest(d - radius, F.lit(0.0))
        weight = (loss if slack is None else F.least(loss, F.lit(float(slack)))) / d
        some = df.withColumn("_d", distance(vector, centre)).filter(d > radius)
        r = some.agg(F.sum(weight).alias("w"), F.count("*").alias("n"), *(F.sum(weight * entry(k)).alias(f"x{k}") for k in range(n))).first()
        if not r["n"]:
            break
        move = (np.array([r[f"x{k}"] for k in range(n)]) - r["w"] * centre) / r["n"]
        centre = centre + move
        if np.abs(move).max() <= stop * max(1.0, np.abs(centre).max()):
            break
    return Ball(centre, radius)


def least_complexity(df: DataFrame, target: str, vector: str, low: float = 1e-4, high: float = 1e4, eps: float = 0.05) -> float | None:
    """The smallest complexity, within a factor of 1 + eps, at which no row is on the wrong side, by bisection of its
    logarithm; None if even ``high`` leaves some."""

    def wrong(c: float) -> bool:
        model = relative_margin(df, target, vector, c, float("inf"))
        return not df.filter(F.col(target) * model.score(vector) <= 0).isEmpty()

    if wrong(high):
        return None
    while high / low > 1 + eps:
        middle = float(np.sqrt(low * high))
        low, high = (middle, high) if wrong(middle) else (low, middle)
    return high
