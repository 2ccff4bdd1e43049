"""Queries of splitters, instance and feature selection, ensembles and score transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import ensemble as G
from sigmill.operators import selection as C
from sigmill.plans.inputs import FEATURES, PREDICTIONS, SAMPLES, features, predictions, samples, table
from sigmill.plans.query import query


def _labels(spark, d):
    return table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("label"))


_LABELS = "l AS (SELECT doc_id AS id, CAST(quality AS BIGINT) AS label FROM labels)"


def _rank(within: str = "") -> str:
    part = f"PARTITION BY {within} " if within else ""
    return f"{_LABELS}, r AS (SELECT *, row_number() OVER ({part}ORDER BY (id * 2654435761) % 4294967296, id) - 1 AS rank, count(*) OVER ({f'PARTITION BY {within}' if within else ''}) AS size FROM l)"


_FOLD = "CAST(" + " + ".join(f"(rank >= round({j} * size / 5.0))::INT" for j in range(1, 5)) + " AS BIGINT)"


@query("cv_folds", f"WITH {_rank()} SELECT id, label, {_FOLD} AS fold FROM r")
def cv_folds(spark, d):
    return C.cv_folds(_labels(spark, d), "id", 5).select("id", "label", "fold")


@query("cv_folds_stratified", f"WITH {_rank('label')} SELECT id, label, {_FOLD} AS fold FROM r")
def cv_folds_stratified(spark, d):
    return C.cv_folds(_labels(spark, d), "id", 5, ["label"]).select("id", "label", "fold")


@query(
    "cv_groups_in_time",
    f"""WITH {SAMPLES}, w AS (SELECT user_id, t, t * 10 + (t % 3) * 7 AS a, t * 10 + (t % 3) * 7 + (t % 5) * 6 AS b FROM samples), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)
    SELECT user_id, t, CAST(sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b) AS BIGINT) AS "group" FROM m""",
)
def cv_groups_in_time(spark, d):
    t = F.col("t")
    w = samples(spark, d).select("user_id", "t", (t * 10 + (t % 3) * 7).alias("a")).withColumn("b", F.col("a") + (t % 5) * 6)
    return C.groups_in_time(w, ["user_id"], "a", "b", F.floor(F.col("a") / 40960)).select("user_id", "t", "group")


@query("train_test_split", f"WITH {_rank()} SELECT id, CASE WHEN rank < round(size * 0.7) THEN 'train' ELSE 'test' END AS part FROM r")
def train_test_split(spark, d):
    return C.train_test(_labels(spark, d), "id", 0.7).select("id", "part")


@query("reduce_overrepresented", f"WITH {_rank('label')} SELECT id, label FROM r WHERE rank < (SELECT min(size) FROM r)")
def reduce_overrepresented(spark, d):
    return C.balance(_labels(spark, d), "label", "id").select("id", "label")


@query("instance_percentage", f"WITH {_rank('label')} SELECT id, label FROM r WHERE rank < round(size * 25.0 / 100)")
def instance_percentage(spark, d):
    return C.percentage(_labels(spark, d), "label", "id", 25.0).select("id", "label")


@query("instance_percentage_of_class", f"WITH {_rank('label')} SELECT id, label FROM r WHERE rank < round(size * 40.0 / 100) OR label <> 1")
def instance_percentage_of_class(spark, d):
    return C.percentage(_labels(spark, d), "label", "id", 40.0, only=1).select("id", "label")


@query(
    "split_classifier_parts",
    f"WITH {_rank('label')}, n AS (SELECT greatest(count(*) FILTER (label = 1) // count(*) FILTER (label = 0), 1) AS parts FROM l) SELECT id, label, rank % parts AS part FROM r, n WHERE label = 1 UNION ALL SELECT id, label, unnest(range(parts)) AS part FROM r, n WHERE label = 0",
)
def split_classifier_parts(spark, d):
    return C.round_robin(_labels(spark, d), "label", "id", 1).select("id", "label", F.col("part").cast("long").alias("part"))


@query("feature_name_filter", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'red') AND (contains(p_name, 'bolt') OR contains(p_name, 'ring') OR p_name IN ('small widget'))")
def feature_name_filter(spark, d):
    return C.name_filter(table(spark, d, "part"), "p_name", exclude=["red"], include=["bolt", "ring"], names=["small widget"]).select("p_partkey", "p_name")


@query(
    "relief_weights",
    """WITH v AS (SELECT vec_id AS id, label % 2 AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT * FROM v WHERE id % 25 = 0),
    p AS (SELECT q.id AS q, v.id AS n, q.label = v.label AS hit, q.x AS qx, v.x AS vx, list_sum(list_transform(range(1, 65), lambda i: power(q.x[i] - v.x[i], 2))) AS d2 FROM q JOIN v ON q.id <> v.id),
    k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY q, hit ORDER BY d2, n) <= 3)
    SELECT CAST(f AS BIGINT) AS f, round(sum(CASE WHEN hit THEN -1 ELSE 1 END * abs(qx[f + 1] - vx[f + 1]) / 3) / (SELECT count(*) FROM q), 6) + 0.0 AS weight FROM k, (SELECT unnest(range(64)) AS f) GROUP BY f""",
)
def relief_weights(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 2).alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    return C.relief(v, "id", "label", "x", F.col("id") % 25 == 0).select("f", r6("weight").alias("weight"))


# ---- ensembles: three simple predictors of document quality ----


def _votes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    j = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("long").alias("truth"), F.col("toxic").cast("long").alias("toxic")).join(docs, "id")
    n = F.col("n_chars")
    scores = {"a": F.round(n % 997 / 300.0 - 1, 4), "b": F.round(n % 89 / 40.0 - 0.8, 4), "c": F.when(F.col("toxic") == 1, -0.5).otherwise(0.7)}
    return j.select("id", "truth", *(s.cast("double").alias(k) for k, s in scores.items())).unpivot(["id", "truth"], list(scores), "predictor", "score").withColumn("label", (F.col("score") > 0).cast("long"))


_VOTES = """j AS (SELECT l.doc_id AS id, CAST(quality AS BIGINT) AS truth, toxic, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
  s AS (SELECT id, truth, 'a' AS predictor, CAST(round(n_chars % 997 / 300.0 - 1, 4) AS DOUBLE) AS score FROM j UNION ALL SELECT id, truth, 'b', round(n_chars % 89 / 40.0 - 0.8, 4) FROM j UNION ALL SELECT id, truth, 'c', CASE WHEN toxic = 1 THEN -0.5 ELSE 0.7 END FROM j),
  votes AS (SELECT *, CASE WHEN score > 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS label FROM s)"""


@query(
    "vote_majority",
    f"WITH {_VOTES}, n AS (SELECT id, label, count(*) AS n, sum(abs(score)) AS s FROM votes GROUP BY id, label), m AS (SELECT id, avg(score) AS score FROM votes GROUP BY id) SELECT id, label, round(score, 6) + 0.0 AS score FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, s DESC, label) = 1) JOIN m USING (id)",
)
def vote_majority(spark, d):
    return G.vote(_votes(spark, d), ["id"]).select("id", "label", r6("score").alias("score"))


@query("vote_by_score", f"WITH {_VOTES}, n AS (SELECT id, label, sum(abs(score)) AS s FROM votes GROUP BY id, label) SELECT id, label, round(s, 6) + 0.0 AS score FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, label) = 1")
def vote_by_score(spark, d):
    return G.vote_by_score(_votes(spark, d), ["id"]).select("id", "label", r6("score").alias("score"))


@query(
    "precision_weighted_vote",
    f"""WITH {_VOTES}, p AS (SELECT predictor, label, avg(CASE WHEN label = truth THEN 1.0 ELSE 0.0 END) AS p FROM votes WHERE id % 2 = 0 GROUP BY 1, 2), w AS (SELECT predictor, label, p / nullif(sum(p) OVER (PARTITION BY label), 0) AS w FROM p)
    SELECT id, round(sum(CASE WHEN label = 1 THEN coalesce(w, 0) ELSE 0 END) / sum(coalesce(w, 0)), 6) AS share FROM votes LEFT JOIN w USING (predictor, label) GROUP BY id""",
)
def precision_weighted_vote(spark, d):
    v = _votes(spark, d)
    return G.weighted_vote(v, G.precision_weights(v.filter("id % 2 = 0")), ["id"], 1).select("id", r6("share").alias("share"))


@query("champion", f"WITH {_VOTES} SELECT predictor, round(2.0 * count(*) FILTER (label = 1 AND truth = 1) / (count(*) FILTER (label = 1) + count(*) FILTER (truth = 1)), 6) AS f FROM votes WHERE id % 2 = 0 GROUP BY predictor ORDER BY f DESC, predictor LIMIT 1")
def champion(spark, d):
    return G.champion(_votes(spark, d).filter("id % 2 = 0"), 1).select("predictor", r6("f").alias("f"))


def _wide(spark, d):
    return _votes(spark, d).groupBy("id", "truth").agg(*(F.max(F.when(F.col("predictor") == p, F.col("label"))).alias(p) for p in "abc"))


@query(
    "knn_hamming",
    f"""WITH {_VOTES}, w AS (SELECT id, truth, max(label) FILTER (predictor = 'a') AS a, max(label) FILTER (predictor = 'b') AS b, max(label) FILTER (predictor = 'c') AS c FROM votes GROUP BY id, truth),
    p AS (SELECT q.id, t.truth, (q.a <> t.a)::INT + (q.b <> t.b)::INT + (q.c <> t.c)::INT AS d FROM w q JOIN w t ON q.id % 2 = 1 AND t.id % 2 = 0), r AS (SELECT *, rank() OVER (PARTITION BY id ORDER BY d) AS r FROM p),
    n AS (SELECT id, truth, count(*) AS n FROM r WHERE r <= 7 GROUP BY id, truth) SELECT id, truth AS predicted FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, truth) = 1""",
)
def knn_hamming(spark, d):
    w = _wide(spark, d)
    return G.knn_hamming(w.filter("id % 2 = 1"), w.filter("id % 2 = 0"), "id", ["a", "b", "c"], "truth", 7)


def _determinant(rows: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = rows
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


_NORMAL = [["aa + 1", "ab", "ac"], ["ab", "bb + 1", "bc"], ["ac", "bc", "cc + 1"]]
_NORMAL = [[f"({x})" for x in r] for r in _NORMAL]
_CRAMER = ", ".join(f"{_determinant([[t if k == c else x for c, x in enumerate(r)] for r, t in zip(_NORMAL, ('ta', 'tb', 'tc'))])} / {_determinant(_NORMAL)} AS x{k}" for k in range(3))


@query(
    "ridge_gating",
    f"""WITH {_VOTES}, w AS (SELECT id, CAST(2 * truth - 1 AS DOUBLE) AS t, CAST(2 * max(label) FILTER (predictor = 'a') - 1 AS DOUBLE) AS a, CAST(2 * max(label) FILTER (predictor = 'b') - 1 AS DOUBLE) AS b, CAST(2 * max(label) FILTER (predictor = 'c') - 1 AS DOUBLE) AS c FROM votes GROUP BY id, truth),
    sums AS (SELECT {", ".join(f"sum({x} * {y}) AS {x}{y}" for x, y in ("aa", "ab", "ac", "bb", "bc", "cc", "ta", "tb", "tc"))} FROM w WHERE id % 2 = 0), solved AS (SELECT {_CRAMER} FROM sums), scored AS (SELECT id, a * x0 + b * x1 + c * x2 AS s FROM w, solved WHERE id % 2 = 1)
    SELECT id, round(s, 6) + 0.0 AS score, CAST(s > 0 AS INTEGER) AS label FROM scored""",
)
def ridge_gating(spark, d):
    """Weights of +-1 votes by ridge regression."""
    w = _wide(spark, d).select("id", *((2 * F.col(c) - 1).cast("double").alias(c) for c in ("a", "b", "c", "truth")))
    x = G.ridge_weights(w.filter("id % 2 = 0"), ["a", "b", "c"], "truth")
    s = sum(F.col(c) * float(v) for c, v in zip("abc", x))
    return w.filter("id % 2 = 1").select("id", r6(s).alias("score"), (s > 0).cast("int").alias("label"))


# ---- scores ----


@query("sigmoid", f"WITH {PREDICTIONS} SELECT id, round(1 / (1 + exp(-2 * score + 0.5)), 6) AS score FROM predictions")
def sigmoid(spark, d):
    return G.sigmoid(predictions(spark, d), a=-2.0, b=0.5).select("id", r6("score").alias("score"))


@query("linear_transformation", f"WITH {PREDICTIONS} SELECT id, round((score + 0.5) * 3, 6) + 0.0 AS score FROM predictions")
def linear_transformation(spark, d):
    return G.linear(predictions(spark, d), offset=0.5, scaling=3.0).select("id", r6("score").alias("score"))


@query("linear_fit", f"WITH {PREDICTIONS}, m AS (SELECT *, abs(min(score) OVER (PARTITION BY fold)) AS lo, abs(max(score) OVER (PARTITION BY fold)) AS hi FROM predictions) SELECT id, round(CASE WHEN score < 0 THEN 0.5 + 0.5 * score / lo ELSE 0.5 + 0.5 * score / hi END, 6) + 0.0 AS score FROM m")
def linear_fit(spark, d):
    return G.linear_fit(predictions(spark, d), ["fold"]).select("id", r6("score").alias("score"))


@query(
    "threshold_sweep",
    f"""WITH {PREDICTIONS}, c AS (SELECT DISTINCT fold, score AS threshold FROM predictions), v AS (SELECT c.fold, threshold, CAST(count(*) FILTER (truth = 1 AND score >= threshold) AS DOUBLE) / count(*) FILTER (truth = 1) AS tpr, CAST(count(*) FILTER (truth = 0 AND score < threshold) AS DOUBLE) / count(*) FILTER (truth = 0) AS tnr FROM c JOIN predictions p ON c.fold = p.fold GROUP BY c.fold, threshold)
    SELECT fold, threshold, round((tpr + tnr) / 2, 6) AS value, row_number() OVER (PARTITION BY fold ORDER BY round((tpr + tnr) / 2, 12) DESC, threshold) = 1 AS best FROM v""",
)
def threshold_sweep(spark, d):
    return G.threshold_sweep(predictions(spark, d), ["fold"], "truth", 1).withColumn("value", r6("value"))


@query("platt_scaling")
def platt_scaling(spark, d):
    """Probabilities by Platt's method: iterative, out of SQL's reach."""
    p = predictions(spark, d)
    a, b = G.platt(p.filter("id % 2 = 0"), "truth", 1)
    return G.sigmoid(p, a=a, b=b).select("id", r6("score").alias("score"))


@query("prediction_to_features", f"WITH {PREDICTIONS} SELECT id, 'prediction' AS feature, score AS x FROM predictions")
def prediction_to_features(spark, d):
    return predictions(spark, d).select("id", F.lit("prediction").alias("feature"), F.col("score").alias("x"))


@query("feature_to_timeseries", f"WITH {FEATURES} SELECT id, f // 8 AS t, max(x) FILTER (f % 8 = 0) AS ch0, max(x) FILTER (f % 8 = 3) AS ch3 FROM features GROUP BY id, f // 8")
def feature_to_timeseries(spark, d):
    f = features(spark, d)
    return f.groupBy("id", F.floor(F.col("f") / 8).alias("t")).agg(F.max(F.when(F.col("f") % 8 == 0, F.col("x"))).alias("ch0"), F.max(F.when(F.col("f") % 8 == 3, F.col("x"))).alias("ch3"))


@query("same_input_concat", f"WITH {FEATURES} SELECT id, '0_f' || f AS feature, x FROM features UNION ALL SELECT id, '1_f' || f, x * x FROM features")
def same_input_concat(spark, d):
    f = features(spark, d)
    one = lambda k, x: f.select("id", F.concat(F.lit(f"{k}_f"), F.col("f").cast("string")).alias("feature"), x.alias("x"))
    return one(0, F.col("x")).unionByName(one(1, F.col("x") * F.col("x")))


@query("one_vs_rest", "SELECT vec_id AS id, CAST(c.label AS BIGINT) AS class, CASE WHEN e.label = c.label THEN 1 ELSE -1 END AS y FROM embeddings e, (SELECT DISTINCT label FROM embeddings) c")
def one_vs_rest(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    classes = e.agg(F.array_sort(F.collect_set("label")).alias("classes"))  # one row with the label names
    return e.crossJoin(F.broadcast(classes)).select("id", "label", F.explode("classes").alias("class")).select("id", F.col("class").cast("long").alias("class"), F.when(F.col("label") == F.col("class"), 1).otherwise(-1).alias("y"))
