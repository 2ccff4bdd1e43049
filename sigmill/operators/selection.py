"""Choosing rows and features: folds, splits, undersampling, windows that must stay together, RELIEF and name filters.

Draws are deterministic: rows are ordered by a portable hash of their id. Ranks over a whole class are computed in two
levels (counts of hash ranges, then a rank inside each range), so no class is sorted in one task.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.functions.expr import spread_hash
from sigmill.operators.segments import running

RANGES = 1 << 10


def ranked(df: DataFrame, within: list[str], row_id: str, order: Column | None = None) -> DataFrame:
    """Adds rank (from 0) and size (of the class) by the order (a 32-bit hash of the id by default), ties by id."""
    df = df.withColumn("_o", spread_hash(row_id) if order is None else order).withColumn("_range", F.floor(F.col("_o") / ((1 << 32) // RANGES)))
    counts = df.groupBy(*within, "_range").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*within)
    before = counts.withColumn("_before", F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).withColumn("size", F.sum("_n").over(whole)).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*within, "_range").orderBy("_o", row_id)) - 1
    return df.withColumn("_inside", inside).join(before, [*within, "_range"]).withColumn("rank", (F.col("_before") + F.col("_inside")).cast("long")).drop("_o", "_range", "_inside", "_before")


def cv_folds(df: DataFrame, row_id: str, folds: int, stratify: list[str] | None = None) -> DataFrame:
    """Adds fold: bounds are round(j n / folds) of the ranked rows, of each class if stratified."""
    out = ranked(df.withColumn("_all", F.lit(0)), stratify or ["_all"], row_id)
    fold = sum((F.col("rank") >= F.round(F.lit(j) * F.col("size") / folds)).cast("int") for j in range(1, folds))
    return out.withColumn("fold", fold.cast("long")).drop("rank", "size", "_all")


def groups_in_time(df: DataFrame, stream: list[str], start: str, end: str, bucket: Column) -> DataFrame:
    """Adds group (from 1): windows that overlap in time stay together, however long their chain is. bucket is a coarse,
    monotone function of the start that bounds a sort."""
    reached = running(df, stream, bucket, [start, end], {"_reach": (F.max, F.col(end))}, itself=False)
    new = (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("long")
    return running(reached, stream, bucket, [start, end], {"group": (F.sum, new)}).drop("_reach")


def train_test(df: DataFrame, row_id: str, ratio: float) -> DataFrame:
    """Adds part: the first round(n ratio) ranked rows train, the others test."""
    out = ranked(df.withColumn("_all", F.lit(0)), ["_all"], row_id)
    return out.withColumn("part", F.when(F.col("rank") < F.round(F.col("size") * ratio), "train").otherwise("test")).drop("rank", "size", "_all")


def balance(df: DataFrame, label: str, row_id: str) -> DataFrame:
    """As many rows of each class as the smallest has."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    return ranked(df, [label], row_id).crossJoin(F.broadcast(sizes)).filter("rank < _least").drop("rank", "size", "_least")


def percentage(df: DataFrame, label: str, row_id: str, percent: float, only=None) -> DataFrame:
    """percent of each class, or of one class and all of the others."""
    out = ranked(df, [label], row_id)
    keep = F.col("rank") < F.round(F.col("size") * percent / 100)
    return out.filter(keep if only is None else keep | (F.col(label) != only)).drop("rank", "size")


def round_robin(df: DataFrame, label: str, row_id: str, major) -> DataFrame:
    """The larger class dealt in turn to n0 / n1 parts; every part gets all of the other class."""
    sizes = df.groupBy((F.col(label) == major).alias("m")).count()
    n = sizes.agg(F.max(F.when(F.col("m"), F.col("count"))).alias("_a"), F.max(F.when(~F.col("m"), F.col("count"))).alias("_b")).select(F.greatest(F.floor(F.col("_a") / F.col("_b")), F.lit(1)).alias("_parts"))
    out = ranked(df, [label], row_id).crossJoin(F.broadcast(n))
    big = out.filter(F.col(label) == major).withColumn("part", F.col("rank") % F.col("_parts"))
    small = out.filter(F.col(label) != major).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    return big.unionByName(small).drop("rank", "size", "_parts")


def name_filter(df: DataFrame, feature: str, exclude: list[str] = (), include: list[str] = (), names: list[str] = ()) -> DataFrame:
    """Features by name patterns: without those that contain an excluded part, with those that contain an included part or are named."""
    keep = F.lit(True)
    for part in exclude:
        keep &= ~F.contains(feature, F.lit(part))
    if include or names:
        some = F.col(feature).isin(list(names)) if names else F.lit(False)
        for part in include:
            some |= F.contains(feature, F.lit(part))
        keep &= some
    return df.filter(keep)


def _relief_sums(vectors: DataFrame, row_id: str, label: str, features: str, asked: list, k: int) -> dict[int, float]:
    """Sums by feature over one block of query rows, of the mean |x - miss| less the mean |x - hit|."""
    ids, labels = np.array([r[0] for r in asked]), np.array([r[1] for r in asked])
    q = np.array([r[2] for r in asked], float)

    def near(batches):
        best: dict = {}
        for b in batches:
            x = np.array(b[features].tolist(), float)
            if not len(x):
                continue
            own, lab = b[row_id].to_numpy(), b[label].to_numpy()
            for s in range(0, len(ids), 256):
                d2 = np.zeros((len(ids[s : s + 256]), len(x)))
                for f in range(x.shape[1]):
                    d2 += (q[s : s + 256, f, None] - x[None, :, f]) ** 2
                for i in range(len(d2)):
                    for hit in (True, False):
                        c = np.flatnonzero((lab == labels[s + i]) == hit)
                        c = c[own[c] != ids[s + i]]
                        if len(c) > k:
                            c = c[d2[i, c] <= np.partition(d2[i, c], k - 1)[k - 1]]
                        c = c[np.lexsort((own[c], d2[i, c]))[:k]]
                        found = best.get((s + i, hit), []) + [(float(d2[i, j]), int(own[j]), np.abs(x[j] - q[s + i])) for j in c]
                        best[s + i, hit] = sorted(found, key=lambda t: t[:2])[:k]
        for (i, hit), found in best.items():
            if found:
                yield pd.DataFrame({"q": ids[i], "hit": hit, "d2": [t[0] for t in found], "n": [t[1] for t in found], "diff": [t[2] for t in found]})

    found = vectors.select(row_id, label, features).mapInPandas(near, "q long, hit boolean, d2 double, n long, diff array<double>")
    rank = F.row_number().over(Window.partitionBy("q", "hit").orderBy("d2", "n"))
    kept = found.withColumn("_r", rank).filter(F.col("_r") <= k).withColumn("_k", F.count("*").over(Window.partitionBy("q", "hit")))
    each = kept.select("hit", "_k", F.posexplode("diff").alias("f", "x"))
    sums = each.groupBy("f").agg(F.sum(F.when(F.col("hit"), -F.col("x")).otherwise(F.col("x")) / F.col("_k")).alias("s"))
    return {r["f"]: r["s"] for r in sums.collect()}  # a row for each feature


def relief(vectors: DataFrame, row_id: str, label: str, features: str, queries: Column, k: int = 3, most: int = 5_000) -> DataFrame:
    """RELIEF weights: for stated query rows, mean over them of (|x - miss| - |x - hit|) / k by feature.

    The query rows are taken in blocks of at most ``most``, one pass over the vectors for each, so any number of them is
    answered and one block at a time is on the driver and in the tasks. Each task finds its nearest k of each kind for each
    query, and the nearest of these are kept by query: tasks x block x 2 k rows move in a pass, however large the table is.
    The weights are sums over the blocks; they are computed when the function is called.
    """
    rows, n, total = vectors.filter(queries).select(row_id, label, features).toLocalIterator(), 0, {}
    while asked := list(islice(rows, most)):
        n += len(asked)
        for f, s in _relief_sums(vectors, row_id, label, features, asked, k).items():
            total[f] = total.get(f, 0.0) + s
    return vectors.sparkSession.createDataFrame([(int(f), s / n) for f, s in sorted(total.items())], "f long, weight double")


def random_features(features: int, keep: int, seed: int = 0) -> list[int]:
    """Numbers of keep of the features, which a hash of number and seed picks."""
    return sorted(sorted(range(features), key=lambda k: (((k + seed * features) * 2654435761) % (1 << 32), k))[:keep])


def take_features(df: DataFrame, vector: str, chosen: list[int], index: str = "f", value: str = "x") -> DataFrame:
    """The chosen entries of each vector in long form, in place of the vector; entries beyond its end are null."""
    rest = [c for c in df.columns if c != vector]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias(index), F.get(vector, F.lit(k)).cast("double").alias(value)) for k in chosen)))
    return df.select(*rest, each.alias("_s")).select(*rest, "_s.*")
