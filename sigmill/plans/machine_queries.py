"""Queries of channel selection, margin machines, searches, live training and stored records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import learners as L
from sigmill.operators import margins as A
from sigmill.operators import search as H
from sigmill.operators import sensors as E
from sigmill.plans.inputs import CHANNELS, FEATURES, PREDICTIONS, RECORDS, RESULTS, WINDOWS, features, predictions, records, results, table, windows
from sigmill.plans.query import query
from sigmill.plans.stream_queries import _events, _to_table, shared_folder
from sigmill.sources import files
from sigmill.streaming import live as V

# ---- channels ----


@query(
    "channel_ssnr",
    f"WITH {RECORDS} " + " UNION ALL ".join(f"SELECT '{c}' AS channel, round((SELECT sum(n * m * m) FROM (SELECT count(*) AS n, avg({c}) AS m FROM records WHERE label = 'A' GROUP BY t)) / (SELECT sum({c} * {c}) FROM records), 6) AS ssnr" for c in CHANNELS),
)
def channel_ssnr(spark, d):
    """Signal over signal and noise of each channel by itself."""
    p = E.powers(records(spark, d), "label", "A", "t", CHANNELS)
    return spark.createDataFrame([(c, round(p.ssnr([k]), 6)) for k, c in enumerate(CHANNELS)], "channel string, ssnr double")


@query("channels_by_ssnr")
def channels_by_ssnr(spark, d):
    """The two channels kept by backward elimination, forward selection and evolutionary search, by the filtered ratio."""
    p = E.powers(records(spark, d), "label", "A", "t", CHANNELS)
    value = lambda own: p.ssnr(own, 1)
    found = {"backward": E.backward_elimination(4, 2, value), "forward": E.forward_selection(4, 2, value), "evolution": E.evolutionary_search(4, 2, value)}
    return spark.createDataFrame([(how, sorted(CHANNELS[k] for k in own), round(value(own), 6)) for how, own in found.items()], "how string, channels array<string>, ssnr double")


def vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4).alias("fold"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("label"), (1.0 - 2 * (F.col("label") % 2)).alias("y"), F.col("embedding").cast("array<double>").alias("x"))


@query("channels_by_performance")
def channels_by_performance(spark, d):
    """Balanced accuracy without each of the entries of a vector, and with the first and one more."""
    v = vectors(spark, d)
    n = v.select(F.size("x")).first()[0]
    subsets = E.remove_one(n) + E.add_one(n, [0])
    out = E.performances(v, "fold", "label", "x", "even", "odd", subsets)
    return out.select(F.when(F.col("subset") < n, "without").otherwise("with").alias("how"), F.when(F.col("subset") < n, F.col("subset")).otherwise(F.col("subset") - n + 1).alias("entry"), r6("mean").alias("mean"))


@query("channels_by_coefficient")
def channels_by_coefficient(spark, d):
    """Entries in the order of a discriminant's weights."""
    v = vectors(spark, d)
    model = L.ridge_classifier(L.moments(v, "label", "x"), "even", "odd")
    return spark.createDataFrame([(rank, k) for rank, k in enumerate(E.coefficient_ranking(model))], "rank int, entry int")


# ---- machines ----


@query("relative_margin")
def relative_margin(spark, d):
    v = vectors(spark, d)
    model = A.relative_margin(v.filter("fold <> 0"), "y", "x", 0.1, 2.0)
    return v.select("id", "label", F.round(model.score("x"), 5).alias("score"))


@query("one_class_margin")
def one_class_margin(spark, d):
    """Learned from one class; the margin of every row."""
    v = vectors(spark, d)
    model = A.one_class(v.filter("label = 'even'"), "x", 0.1, 2.0)
    return v.select("id", "label", F.round(model.score("x") + 1, 5).alias("margin"))


@query("support_vector_regression")
def support_vector_regression(spark, d):
    v = vectors(spark, d)
    model = A.regression(v, "y", "x", 0.1, 0.1)
    return v.select("id", F.round(model.score("x"), 5).alias("predicted"))


@query("data_description")
def data_description(spark, d):
    """Distance beyond a ball around one class, by the plain and by the bounded step."""
    v = vectors(spark, d)
    balls = {name: A.data_description(v.filter("label = 'even'"), "x", 0.5, slack) for name, slack in (("plain", None), ("bounded", 0.2))}
    return v.select("id", *(F.round(b.score("x"), 4).alias(name) for name, b in balls.items()))


@query("pattern_search")
def pattern_search(spark, d):
    """The decimal logarithm of a ridge classifier's penalty, from 0, by balanced accuracy over folds."""
    parts = vectors(spark, d)

    def value(points):
        rows = H.grid(parts, "fold", "label", "x", "even", "odd", [10.0 ** p[0] for p in points]).collect()
        by = {round(r["tau"], 12): r["Balanced_accuracy_mean"] for r in rows}
        return [by[round(10.0 ** p[0], 12)] for p in points]

    point, best = H.pattern_search(value, [0.0], step=1.0, stop=0.5, low=[-3.0], high=[3.0])
    return spark.createDataFrame([(float(point[0]), round(best, 6))], "log_tau double, value double")


# ---- live ----

_MIDPOINT = "SELECT user_id, round((avg(value) FILTER (event_type = 'purchase') + avg(value) FILTER (event_type = 'view')) / 2, 6) AS threshold, CASE WHEN avg(value) FILTER (event_type = 'purchase') >= avg(value) FILTER (event_type = 'view') THEN 1 ELSE -1 END AS side FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'view') > 0"


@query("live_train", _MIDPOINT)
def live_train(spark, d):
    """A threshold between two kinds of events for each user, learned from a recorded stream: one aggregate for all users."""
    sums = V.class_sums(table(spark, d, "events"), "user_id", "event_type", "value", "purchase", "view")
    return V.midpoints(sums, "user_id", "event_type", "purchase", "view").select("user_id", r6("threshold").alias("threshold"), "side")


@query("live_adapt", _MIDPOINT)
def live_adapt(spark, d):
    """The same thresholds kept up to date by a stream: sums by user are the state, and each batch moves the thresholds."""
    kept = _to_table(spark, V.class_sums(_events(spark, d), "user_id", "event_type", "value", "purchase", "view"), "complete")
    return V.midpoints(kept, "user_id", "event_type", "purchase", "view").select("user_id", r6("threshold").alias("threshold"), "side")


# ---- stored records ----


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("feature_vector_sink", f"WITH {FEATURES} SELECT id, id % 3 AS split, CASE WHEN id % 5 = 0 THEN 'test' ELSE 'train' END AS part, f, x FROM features")
def feature_vector_sink(spark, d):
    """Vectors stored by split and part, and read again."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("split"), F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("part"), F.col("embedding").cast("array<double>").alias("x"))
    read = files.stored(spark, e, _folder(spark, "vectors"), ["split", "part"])
    return read.select("id", "split", "part", F.posexplode("x").alias("f", "x")).withColumn("f", F.col("f").cast("long"))


@query("prediction_sink", f"WITH {PREDICTIONS} SELECT id, fold, truth, predicted, score FROM predictions")
def prediction_sink(spark, d):
    p = predictions(spark, d).select("id", "fold", "truth", "predicted", "score")
    return files.stored(spark, p, _folder(spark, "predictions"), ["fold"])


@query("csv_features", "SELECT CAST(label AS VARCHAR) AS label, vec_id AS id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def csv_features(spark, d):
    """Whole vectors in a file without a header, the label first, read as labelled features."""
    path = _folder(spark, "csv")
    x = F.col("embedding").cast("array<double>").cast("array<string>")
    table(spark, d, "embeddings").select(F.concat_ws(", ", F.col("label").cast("string"), F.col("vec_id").cast("string"), F.array_join(x, ", "))).write.text(path)
    read = files.csv_features(spark, path)
    return read.select("label", F.col("features")[0].cast("long").alias("id"), F.posexplode(F.slice("features", 2, 1 << 20)).alias("f", "x"))


@query("arff_table", "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderpriority AS \"the priority\", CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def arff_table(spark, d):
    """Rows of a file whose header declares its columns, quoted names and values included."""
    path = _folder(spark, "arff")
    head = ["% orders", "@relation orders", "@attribute o_orderkey numeric", "@attribute 'the priority' string", "@ATTRIBUTE o_totalprice real", "@data"]
    rows = table(spark, d, "orders").select(F.format_string("%s, '%s', %s", F.col("o_orderkey").cast("string"), "o_orderpriority", F.col("o_totalprice").cast("double").cast("string")).alias("value"))
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).unionByName(rows).write.text(path)
    return files.arff(spark, path)


@query("result_table", f"WITH {RESULTS} SELECT __dataset, __method, CAST(__run AS VARCHAR) AS __run, CAST(metric AS DOUBLE) AS metric, CAST(time AS DOUBLE) AS time FROM results")
def result_table(spark, d):
    """A performance table written, and read with its metrics as numbers."""
    path = _folder(spark, "results")
    files.results(results(spark, d).select("metric", "time", "__run", "__method", "__dataset"), path)
    return files.read_results(spark, path, ["metric", "time"]).select("__dataset", "__method", "__run", "metric", "time")


@query("window_sink", f"WITH {WINDOWS} SELECT user_id, win, k, marker, value FROM windows")
def window_sink(spark, d):
    """Windows stored with those of one stretch of time together, each file in order, and read again."""
    w = windows(spark, d).select("user_id", "win", "k", "marker", "value")
    return files.stored(spark, w, _folder(spark, "windows"), [], ["user_id", "win", "k"])


@query("multiple_csv", f"WITH {RESULTS} SELECT __dataset, __run, row, round(metric, 2) AS metric, CASE WHEN __run = 1 THEN round(time, 2) END AS time FROM results")
def multiple_csv(spark, d):
    """Result files of several runs, one of them with a column of its own, as one table; the run is in the file's name."""
    folder = _folder(spark, "results")
    r = results(spark, d).withColumns({"metric": F.round("metric", 2), "time": F.round("time", 2)})
    for run in range(3):
        files.results(r.filter(F.col("__run") == run).select("__dataset", "row", "metric", *(["time"] if run == 1 else [])), f"{folder}/results_{run}")
    out = files.read_many_results(spark, {f"{folder}/results_{run}": {"__run": run} for run in range(3)})
    return out.select("__dataset", F.col("__run").cast("long").alias("__run"), F.col("row").cast("long").alias("row"), F.col("metric").cast("double").alias("metric"), F.col("time").cast("double").alias("time"))
