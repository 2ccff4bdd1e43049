"""Queries of margin machines by other ways, several classes, searches, stored and self-trained models, and frames."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import features as X
from sigmill.operators import learners as L
from sigmill.operators import margins as A
from sigmill.operators import models as D
from sigmill.operators import search as H
from sigmill.plans.inputs import SAMPLES, samples, table
from sigmill.plans.machine_queries import vectors
from sigmill.plans.query import query
from sigmill.plans.stream_queries import shared_folder
from sigmill.streaming import adapting as S


@query("absolute_margin")
def absolute_margin(spark, d):
    """The linear-programming machine; with its objective and the proven bound."""
    v = vectors(spark, d)
    m = A.absolute_margin(v.filter("fold <> 0"), "y", "x", 0.5, 2.0)
    return v.select("id", "label", F.round(m.score("x"), 2).alias("score"), F.lit(round(m.objective, 3)).alias("objective"), F.lit(m.objective - m.bound <= 1e-6 * m.objective).alias("proven"))


@query("margin_by_regression")
def margin_by_regression(spark, d):
    v = vectors(spark, d)
    return v.select("id", "label", F.round(A.margin_by_regression(v.filter("fold <> 0"), "y", "x", 0.1, 2.0).score("x"), 5).alias("score"))


@query("kernel_machine")
def kernel_machine(spark, d):
    """Radial kernel on 64 landmarks."""
    v = vectors(spark, d)
    m = A.kernel_machine(v.filter("fold <> 0"), "y", "x", 1.0, "rbf", 0.5, 64)
    return m.score(v, "x").select("id", "label", F.round("score", 4).alias("score"))


_G = """e AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS label, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


@query(
    "one_against_one",
    f"""WITH {_G}, m AS (SELECT label AS c, f, avg(x) AS m FROM e GROUP BY label, f),
    g AS (SELECT id, c, sum(x * m) - sum(m * m) / 2 AS g FROM e JOIN m USING (f) GROUP BY id, c),
    v AS (SELECT a.id, a.c, sum(CASE WHEN a.c < b.c THEN CAST(a.g > b.g AS INT) ELSE CAST(b.g <= a.g AS INT) END) AS votes, sum(a.g - b.g) AS total FROM g a JOIN g b ON a.id = b.id AND a.c <> b.c GROUP BY a.id, a.c)
    SELECT id, c AS predicted, CAST(votes AS INTEGER) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, total DESC, c) AS r FROM v) WHERE r = 1""",
)
def one_against_one(spark, d):
    """Votes of all pairs of classes, each decided by the nearer mean."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("x"))
    return L.vote_of_pairs(v, L.one_against_one(L.moments(v, "label", "x"), L.nearest_mean), "x").select("id", "predicted", "votes")


@query("one_against_one_lda")
def one_against_one_lda(spark, d):
    """The same with a discriminant for each pair."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("x"))
    return L.vote_of_pairs(v, L.one_against_one(L.moments(v.filter("id % 2 = 0"), "label", "x")), "x").select("id", "label", "predicted", "votes")


def _moved_mean(m, a, b, shift, pull):
    """The nearer mean, with the offset moved and the first class's mean pulled towards 0."""
    p, q = m.mean(a) * pull, m.mean(b)
    return L.Linear(p - q, float(q @ q - p @ p) / 2 + shift)


@query(
    "parameter_search",
    """WITH e AS (SELECT vec_id AS id, vec_id % 4 AS fold, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS pos, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    grid AS (SELECT * FROM (VALUES (-0.05), (0.0), (0.05)) s(shift), (VALUES (0.5), (1.0)) p(pull)),
    m AS (SELECT k.fold, f, avg(x) FILTER (pos = 1) AS p, avg(x) FILTER (pos = 0) AS q FROM (SELECT DISTINCT fold FROM e) k JOIN e ON e.fold <> k.fold GROUP BY k.fold, f),
    s AS (SELECT id, e.fold, pos, shift, pull, sum(x * (pull * p - q)) + sum(q * q - pull * pull * p * p) / 2 + shift AS score FROM e JOIN m ON m.fold = e.fold AND m.f = e.f, grid GROUP BY id, e.fold, pos, shift, pull),
    b AS (SELECT fold, shift, pull, (avg(CAST(score > 0 AS INT)) FILTER (pos = 1) + avg(CAST(score <= 0 AS INT)) FILTER (pos = 0)) / 2 AS ba FROM s GROUP BY fold, shift, pull),
    o AS (SELECT CAST(shift AS DOUBLE) AS shift, CAST(pull AS DOUBLE) AS pull, avg(ba) AS mean, stddev_pop(ba) AS std, avg(ba) - 0.5 * stddev_pop(ba) AS objective FROM b GROUP BY shift, pull)
    SELECT shift, pull, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(objective, 6) + 0.0 AS objective, row_number() OVER (PARTITION BY pull ORDER BY round(objective, 9) DESC, shift) = 1 AS best FROM o""",
)
def parameter_search(spark, d):
    """A grid over two parameters with a penalty on the spread over folds; the best of every value of the second."""
    found = H.parameter_search(vectors(spark, d), "fold", "label", "x", "even", "odd", _moved_mean, {"shift": [-0.05, 0.0, 0.05], "pull": [0.5, 1.0]}, std_weight=0.5, each=["pull"])
    return found.table.select("shift", "pull", *(r6(c).alias(c) for c in ("mean", "std", "objective")), "best")


@query(
    "stored_models",
    f"""WITH {_G}, y AS (SELECT *, CASE WHEN CAST(label AS INT) % 2 = 0 THEN 1 ELSE 0 END AS pos FROM e),
    m AS (SELECT k.part, f, avg(x) FILTER (pos = 1) AS p, avg(x) FILTER (pos = 0) AS q FROM (VALUES (0), (1), (2)) k(part) JOIN y ON (k.part = 2 OR y.id % 2 = k.part) GROUP BY k.part, f),
    s AS (SELECT id, part, sum(x * (p - q)) + sum(q * q - p * p) / 2 AS score FROM y JOIN m USING (f) GROUP BY id, part)
    SELECT id, round(max(score) FILTER (part = 0), 6) + 0.0 AS even_rows, round(max(score) FILTER (part = 1), 6) + 0.0 AS odd_rows, round(max(score) FILTER (part = 2), 6) + 0.0 AS adapted FROM s GROUP BY id""",
)
def stored_models(spark, d):
    """Models fitted on parts, stored, loaded by a pattern, adapted by the other part's sums, and applied in one pass."""
    v, path = vectors(spark, d), f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    parts = {k: L.moments(v.filter(F.col("id") % 2 == n), "label", "x") for n, k in enumerate(("even_rows", "odd_rows"))}
    D.save(spark, [D.Model(f"part/{k}", "nearest_mean", "even", "odd", m) for k, m in parts.items()] + [D.Model("other", "lda", "even", "odd", parts["odd_rows"])], path)
    found = {m.name.split("/")[1]: m for m in D.load(spark, path, "part/*")}
    adapted = found["even_rows"].adapted(parts["odd_rows"])
    adapted.name = "part/adapted"
    scored = D.apply_all(v, [*found.values(), adapted], "x")
    return scored.select("id", *(r6(F.col("scores")[f"part/{k}"]).alias(k) for k in ("even_rows", "odd_rows", "adapted")))


@query("self_training")
def self_training(spark, d):
    """A model learned from few rows goes on learning from a stream of the others, under its own confident labels."""
    v, root = vectors(spark, d).select("id", "label", "x"), f"{shared_folder(spark)}/self-{uuid.uuid4().hex}"
    v.filter("id % 5 <> 0").write.parquet(f"{root}/rows")
    start = D.Model("self", "nearest_mean", "even", "odd", L.moments(v.filter("id % 5 = 0"), "label", "x"))
    S.self_train(spark.readStream.schema(v.schema).parquet(f"{root}/rows"), start, "x", root, confidence=0.05).awaitTermination()
    last = S.last_model(spark, root)
    return v.select("id", "label", r6(last.score("x")).alias("score"))


_FRAME, _HOP = 8, 4


def _stft_sql() -> str:
    bins = " UNION ALL ".join(f"SELECT {b} AS bin" for b in range(_FRAME // 2 + 1))
    hann = f"(0.5 - 0.5 * cos(2 * pi() * k / {_FRAME - 1}))"
    weight = f"(SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * k / {_FRAME - 1}), 2)) FROM range({_FRAME}) r(k))"
    return f"""WITH {SAMPLES}, b AS ({bins}),
    x AS (SELECT user_id, frame, t - frame * {_HOP} AS k, value FROM (SELECT user_id, t, value, unnest(range(greatest(0, CAST(ceil((t - {_FRAME - 1}) / {_HOP}) AS BIGINT)), t // {_HOP} + 1)) AS frame FROM samples)),
    s AS (SELECT user_id, frame, bin, count(*) AS n, sum(value * {hann} * cos(2 * pi() * bin * k / {_FRAME})) AS c, sum(value * {hann} * sin(2 * pi() * bin * k / {_FRAME})) AS s FROM x, b GROUP BY user_id, frame, bin)
    SELECT user_id, frame, bin, round(10 * log10((c * c + s * s) * (CASE WHEN bin IN (0, {_FRAME // 2}) THEN 1.0 ELSE 2.0 END) / ({weight} * 100)), 3) + 0.0 AS power FROM s WHERE n = {_FRAME}"""


@query("stft", _stft_sql())
def stft(spark, d):
    """Power of overlapping Hann frames of each stream, in decibels."""
    out = X.stft(samples(spark, d), "value", ["user_id"], "t", _FRAME, _HOP, 100.0)
    return out.select("user_id", "frame", "bin", (F.round("power", 3) + 0.0).alias("power"))
