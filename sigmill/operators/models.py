"""A store of fitted models: each is the sums it was fitted from, with what makes a model of them.

A model is a name, a kind (one of ``KINDS``), parameters and the sums of its training rows by class. Since sums add up, a
model is adapted to new rows by adding theirs, without the old ones, and is then what a fit on all of them would be. All
models of a pattern are applied in one pass, as one array of scores.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import learners as L
from sigmill.operators import search as H

KINDS: dict[str, Callable] = {
    "lda": lambda m, a, b, **p: L.lda(m, a, b, p.get("ridge", 1e-6)),
    "qda": lambda m, a, b, **p: L.qda(m, a, b, p.get("ridge", 1e-3)),
    "ridge": lambda m, a, b, **p: L.ridge_classifier(m, a, b, p.get("tau", 1.0)),
    "bayesian": lambda m, a, b, **p: H.bayesian_lda(m, a, b),
    "nearest_mean": lambda m, a, b, **p: L.nearest_mean(m, a, b),
}
SCHEMA = "name string, kind string, positive string, negative string, parameters map<string,double>, class string, n bigint, s array<double>, q array<array<double>>"


@dataclass
class Model:
    name: str
    kind: str
    positive: str
    negative: str
    sums: L.Moments
    parameters: dict[str, float] = field(default_factory=dict)

    def fitted(self):
        return KINDS[self.kind](self.sums, self.positive, self.negative, **self.parameters)

    def score(self, vector: str) -> Column:
        return self.fitted().score(vector)

    def adapted(self, more: L.Moments) -> Model:
        """With the sums of further rows."""
        return replace(self, sums=added(self.sums, more))


def added(a: L.Moments, b: L.Moments) -> L.Moments:
    out = L.Moments(dict(a.n), dict(a.s), dict(a.q))
    for c in b.n:
        out.n[c], out.s[c], out.q[c] = out.n.get(c, 0) + b.n[c], out.s.get(c, 0) + b.s[c], out.q.get(c, 0) + b.q[c]
    return out


def save(spark: SparkSession, models: list[Model], path: str, mode: str = "append") -> None:
    """A row for each model and class."""
    rows = [(m.name, m.kind, m.positive, m.negative, {k: float(v) for k, v in m.parameters.items()}, c, int(m.sums.n[c]), m.sums.s[c].tolist(), m.sums.q[c].tolist()) for m in models for c in m.sums.classes]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def load(spark: SparkSession, path: str, pattern: str = "*") -> list[Model]:
    """The models whose names match the pattern (* for any run of characters, ? for one), by name. Models are few and small;
    their sums are filtered by name where they are stored."""
    like = "".join({"*": "%", "?": "_"}.get(c, f"\\{c}" if c in "%_\\" else c) for c in pattern)
    out: dict[str, Model] = {}
    for r in spark.read.schema(SCHEMA).parquet(path).filter(F.col("name").like(like)).orderBy("name", "class").collect():
        m = out.setdefault(r["name"], Model(r["name"], r["kind"], r["positive"], r["negative"], L.Moments({}, {}, {}), dict(r["parameters"])))
        m.sums.n[r["class"]], m.sums.s[r["class"]], m.sums.q[r["class"]] = r["n"], np.array(r["s"]), np.array(r["q"])
    return list(out.values())


def apply_all(df: DataFrame, models: list[Model], vector: str, name: str = "scores") -> DataFrame:
    """df with the scores of all models by name, in one pass."""
    return df.withColumn(name, F.create_map(*(x for m in models for x in (F.lit(m.name), m.score(vector)))))


def cached_scores(df: DataFrame, models: list[Model], vector: str, cache: str, name: str = "scores") -> DataFrame:
    """The same by way of a table of scores that are known for a vector: only vectors that aren't in it are scored, and
    are then added to it. Vectors are told apart by themselves; their hash only deals them out."""
    spark = df.sparkSession
    schema = f"_h bigint, _v {df.schema[vector].dataType.simpleString()}, _m string, _s double"
    try:
        known = spark.read.schema(schema).parquet(cache)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], schema)
    asked = df.select(F.xxhash64(vector).alias("_h"), F.col(vector).alias("_v"), F.explode(F.array(*(F.lit(m.name) for m in models))).alias("_m")).filter("_v IS NOT NULL").distinct()
    new = apply_all(asked.join(known, ["_h", "_v", "_m"], "left_anti"), models, "_v", "_all").select("_h", "_v", "_m", F.col("_all")[F.col("_m")].alias("_s"))
    new.write.mode("append").parquet(cache)
    every = spark.read.schema(schema).parquet(cache).filter(F.col("_m").isin([m.name for m in models]))
    every = every.groupBy(F.col("_h").alias("_known_h"), F.col("_v").alias("_known_v")).agg(F.map_from_entries(F.collect_list(F.struct("_m", "_s"))).alias(name))  # a row for each model
    return df.join(every, (F.xxhash64(vector) == F.col("_known_h")) & (F.col(vector) == F.col("_known_v")), "left").drop("_known_h", "_known_v")
