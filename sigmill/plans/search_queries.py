"""Queries of parameter searches, and of splitters and features over several channels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import learners as L
from sigmill.operators import search as H
from sigmill.plans.inputs import CHANNELS, FEATURES, SAMPLES, WINDOWS, features, records, samples, table, windows
from sigmill.plans.query import query


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("fold"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


@query("grid_search")
def grid_search(spark, d):
    out = H.grid(_vectors(spark, d), "fold", "label", "x", "even", "odd", [0.01, 0.1, 1.0, 10.0, 100.0])
    return out.select("tau", r6("Balanced_accuracy_mean").alias("mean"), r6("Balanced_accuracy_std").alias("std"), "best")


@query("bayesian_lda")
def bayesian_lda(spark, d):
    v = _vectors(spark, d)
    model = H.bayesian_lda(L.moments(v.filter("fold <> 0"), "label", "x"), "even", "odd")
    return v.select("id", "label", F.round(model.score("x"), 4).alias("score"))


@query("xdawn")
def xdawn(spark, d):
    r = records(spark, d)
    f = H.xdawn(r, "label", "A", "t", CHANNELS, 2)
    x = F.array(*(F.col(c) for c in CHANNELS))
    return r.select("win", "t", *(F.round(L.dot(x, f[:, k]), 5).alias(f"c{k}") for k in range(2)))


@query("sparse_xdawn")
def sparse_xdawn(spark, d):
    """The two channels, scaled to equal power, that a sparse filter for the evoked response keeps."""
    r = records(spark, d)
    size = r.agg(*(F.sqrt(F.avg(F.col(c) * F.col(c))).alias(c) for c in CHANNELS)).first()
    r = r.select("win", "t", "label", *((F.col(c) / size[c]).alias(c) for c in CHANNELS))
    chosen, w = H.sparse_filter(*H.response_power(r, "label", "A", "t", CHANNELS), 2, 0.1)
    return spark.createDataFrame([(CHANNELS[c], round(float(x), 4)) for c, x in zip(chosen, w)], "channel string, weight double")


def _mixed_sql(k: str) -> str:
    for _ in range(2):
        k = f"((xor({k}, ({k}) >> 16) * 73244475) % 4294967296)"
    return f"xor({k}, {k} >> 16)"


_weight_sql = lambda j: "sqrt(-2 * ln((u0 + 0.5) / 4294967296.0)) * cos(2 * pi() * (u1 + 0.5) / 4294967296.0)".replace("u0", _mixed_sql(f"(m + {2 * j})")).replace("u1", _mixed_sql(f"(m + {2 * j + 1})"))


@query("random_projection", f"WITH {FEATURES}, w AS (SELECT f, {', '.join(f'{_weight_sql(j)} AS w{j}' for j in range(3))} FROM (SELECT DISTINCT f, {_mixed_sql('f')} AS m FROM features)) SELECT id, {', '.join(f'round(sum(x * w{j}), 5) + 0.0 AS p{j}' for j in range(3))} FROM features JOIN w USING (f) GROUP BY id")
def random_projection(spark, d):
    return H.random_projection(features(spark, d), "id", "f", "x", 3).select("id", *((F.round(f"p{k}", 5) + 0.0).alias(f"p{k}") for k in range(3)))


@query(
    "coherence",
    f"""WITH {WINDOWS}, w AS (SELECT user_id, win, k, value AS a, lag(value, 1, 0.0) OVER (PARTITION BY user_id, win ORDER BY k) + value / 2 AS b FROM windows), f AS (SELECT user_id, win, f, sum(a * cos(2 * pi() * f * k / 16)) AS ar, -sum(a * sin(2 * pi() * f * k / 16)) AS ai, sum(b * cos(2 * pi() * f * k / 16)) AS br, -sum(b * sin(2 * pi() * f * k / 16)) AS bi FROM w, (SELECT unnest(range(1, 8)) AS f) GROUP BY user_id, win, f HAVING count(*) = 16)
    SELECT user_id, f, count(*) AS n, round((power(sum(ar * br + ai * bi), 2) + power(sum(ai * br - ar * bi), 2)) / (sum(ar * ar + ai * ai) * sum(br * br + bi * bi)), 6) + 0.0 AS coherence FROM f GROUP BY user_id, f HAVING count(*) >= 3""",
)
def coherence(spark, d):
    """Magnitude-squared coherence of two channels by frequency, averaged over the windows of a stream."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "win").orderBy("k")
    x = windows(spark, d).select("user_id", "win", "k", F.col("value").alias("a"), (F.lag("value", 1, 0.0).over(w) + F.col("value") / 2).alias("b"))
    turn = lambda f: 2 * math.pi * f * F.col("k") / 16
    parts = [e.alias(f"{c}{p}{f}") for f in range(1, 8) for c in "ab" for p, e in (("r", F.sum(F.col(c) * F.cos(turn(f)))), ("i", -F.sum(F.col(c) * F.sin(turn(f)))))]
    per = x.groupBy("user_id", "win").agg(F.count("*").alias("n"), *parts).filter("n = 16")
    each = per.select("user_id", F.explode(F.array(*(F.struct(F.lit(f).cast("long").alias("f"), *(F.col(f"{c}{p}{f}").alias(f"{c}{p}") for c in "ab" for p in "ri")) for f in range(1, 8)))).alias("s")).select("user_id", "s.*")
    ar, ai, br, bi = (F.col(c) for c in ("ar", "ai", "br", "bi"))
    cross = F.pow(F.sum(ar * br + ai * bi), F.lit(2)) + F.pow(F.sum(ai * br - ar * bi), F.lit(2))
    out = each.groupBy("user_id", "f").agg(F.count("*").alias("n"), r6(cross / (F.sum(ar * ar + ai * ai) * F.sum(br * br + bi * bi))).alias("coherence"))
    return out.filter("n >= 3")


@query("marker_to_mux_channel", f"WITH {SAMPLES} SELECT user_id, t, 'value' AS channel, round(value, 6) + 0.0 AS value FROM samples UNION ALL SELECT user_id, t, 'Marker', CASE marker WHEN 'purchase' THEN 8.0 WHEN 'error' THEN 271.0 ELSE 0.0 END FROM samples")
def marker_to_mux_channel(spark, d):
    code = F.when(F.col("marker") == "purchase", 8.0).when(F.col("marker") == "error", 255.0 + 16).otherwise(0.0)
    both = F.explode(F.array(F.struct(F.lit("value").alias("channel"), F.col("value").alias("v")), F.struct(F.lit("Marker").alias("channel"), code.alias("v")))).alias("s")
    return samples(spark, d).select("user_id", "t", both).select("user_id", "t", "s.channel", r6("s.v").alias("value"))


@query("transfer_split", f"WITH {SAMPLES} SELECT user_id, t, CAST(s AS BIGINT) AS segment, CAST(f AS BIGINT) AS fold, CASE WHEN s = f THEN 'test' ELSE 'train' END AS part FROM (SELECT user_id, t, least(t // 20, 3) AS s, marker FROM samples), (SELECT unnest(range(4)) AS f) WHERE CASE WHEN s = f THEN marker IN ('purchase', 'view') ELSE marker IN ('purchase', 'click') END")
def transfer_split(spark, d):
    """Leave one segment out; training and test windows come from different definitions."""
    seg = F.least(F.floor(F.col("t") / 20), F.lit(3).cast("long"))
    out = samples(spark, d).select("user_id", "t", "marker", seg.alias("segment"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("fold"))
    test = F.col("segment") == F.col("fold")
    return out.filter(F.when(test, F.col("marker").isin("purchase", "view")).otherwise(F.col("marker").isin("purchase", "click"))).select("user_id", "t", "segment", "fold", F.when(test, "test").otherwise("train").alias("part"))


@query("feature_differences", f"WITH {FEATURES} SELECT a.id, a.f, round(b.x - a.x, 6) + 0.0 AS d2, round(a.x - 2 * b.x + 2 * c.x - e.x, 6) + 0.0 AS d5 FROM features a JOIN features b ON a.id = b.id AND b.f = a.f + 1 JOIN features c ON a.id = c.id AND c.f = a.f + 3 JOIN features e ON a.id = e.id AND e.f = a.f + 4")
def feature_differences(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("f")
    at = lambda k: F.lead("x", k).over(w)
    out = features(spark, d).select("id", "f", (at(1) - F.col("x")).alias("d2"), (F.col("x") - 2 * at(1) + 2 * at(3) - at(4)).alias("d5"))
    return out.filter("d5 IS NOT NULL").select("id", "f", r6("d2").alias("d2"), r6("d5").alias("d5"))
