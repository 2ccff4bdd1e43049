"""Queries of the windower and of the table library."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.operators import tables as B
from sigmill.operators import windower as W
from sigmill.plans.inputs import RESULTS, SAMPLES, results, samples, table
from sigmill.plans.query import query

_BASE = dict(name="buy", label="target", marker="purchase", start=-3, end=4)


def _windows(spark, d, **more):
    s = samples(spark, d)
    return W.extract(s, W.marker_windows(s, [W.WindowDef(**_BASE, **more)], ["user_id"]), ["user_id"], "value").select("user_id", "m", "label", "k", r6("value").alias("value"))


def _window_sql(condition: str = "") -> str:
    return f"""WITH {SAMPLES}, w AS (SELECT user_id, t AS m FROM samples a WHERE marker = 'purchase' {condition}),
    x AS (SELECT w.user_id, m, s.t - m + 3 AS k, s.value FROM w JOIN samples s ON s.user_id = w.user_id AND s.t BETWEEN m - 3 AND m + 4)
    SELECT user_id, m, 'target' AS label, k, round(value, 6) + 0.0 AS value FROM x WHERE (user_id, m) IN (SELECT (user_id, m) FROM x GROUP BY user_id, m HAVING count(*) = 8)"""


@query("marker_window", _window_sql())
def marker_window(spark, d):
    return _windows(spark, d)


@query("marker_exclude", _window_sql("AND NOT EXISTS (SELECT 1 FROM samples b WHERE b.user_id = a.user_id AND b.marker = 'error' AND b.t BETWEEN a.t - 4 AND a.t + 2)"))
def marker_exclude(spark, d):
    return _windows(spark, d, exclude=(W.Near("error", 4, 2),))


@query("marker_include", _window_sql("AND EXISTS (SELECT 1 FROM samples b WHERE b.user_id = a.user_id AND b.marker = 'click' AND b.t BETWEEN a.t - 3 AND a.t)"))
def marker_include(spark, d):
    return _windows(spark, d, include=(W.Near("click", 3, 0),))


@query("marker_skip_and_self_exclude", _window_sql("AND a.t >= 10 AND NOT EXISTS (SELECT 1 FROM samples b WHERE b.user_id = a.user_id AND b.marker = 'purchase' AND b.t <> a.t AND b.t BETWEEN a.t - 2 AND a.t + 2)"))
def marker_skip_and_self_exclude(spark, d):
    return _windows(spark, d, exclude=(W.Near("purchase", 2, 2),), skip_first=10)


@query(
    "null_marker_windows",
    f"""WITH {SAMPLES}, w AS (SELECT user_id, t AS m FROM samples WHERE t % 5 = 0), x AS (SELECT w.user_id, m, s.t - m AS k, s.value FROM w JOIN samples s ON s.user_id = w.user_id AND s.t BETWEEN m AND m + 3)
    SELECT user_id, m, k, round(value, 6) + 0.0 AS value FROM x WHERE (user_id, m) IN (SELECT (user_id, m) FROM x GROUP BY user_id, m HAVING count(*) = 4)""",
)
def null_marker_windows(spark, d):
    s = samples(spark, d)
    nulls = W.null_markers(s, ["user_id"], "t", 5)
    w = W.marker_windows(nulls, [W.WindowDef("none", "standard", "null", 0, 4, no_overlap=True)], ["user_id"])
    return W.extract(s, w, ["user_id"], "value").select("user_id", "m", "k", r6("value").alias("value"))


@query(
    "sliding_window",
    f"WITH {SAMPLES}, w AS (SELECT DISTINCT user_id, CAST(t // 4 AS BIGINT) AS win FROM samples) SELECT s.user_id, win, s.t - win * 4 AS k, round(s.value, 6) + 0.0 AS value FROM w JOIN samples s ON s.user_id = w.user_id AND s.t BETWEEN win * 4 AND win * 4 + 11",
)
def sliding_window(spark, d):
    return W.sliding(samples(spark, d), "t", 12, 4).select("user_id", "win", "k", r6("value").alias("value"))


@query(
    "trial_sessions",
    f"""WITH {SAMPLES}, x AS (SELECT *, max(CASE WHEN marker = 'signup' THEN t END) OVER (PARTITION BY user_id ORDER BY t) AS began, max(CASE WHEN marker = 'error' THEN t END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM samples)
    SELECT user_id, began, t, marker FROM x WHERE began IS NOT NULL AND (ended IS NULL OR ended < began)""",
)
def trial_sessions(spark, d):
    return W.trials(samples(spark, d), ["user_id"], "t", "marker", "signup", "error").select("user_id", "began", "t", "marker")


@query(
    "filter_windows_pairing",
    f"""WITH {SAMPLES}, x AS (SELECT *, max(CASE WHEN marker = 'click' THEN t END) OVER w AS last, max(CASE WHEN marker = 'purchase' THEN t END) OVER w AS other FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT user_id, t AS trigger_t, CASE WHEN other IS NULL OR last > other THEN last END AS event_t, t - CASE WHEN other IS NULL OR last > other THEN last END AS waited FROM x WHERE marker = 'purchase'""",
)
def filter_windows_pairing(spark, d):
    return W.pair_with_trigger(samples(spark, d), ["user_id"], "t", "marker", "click", "purchase")


# ---- tables ----


@query("strip_filter", f"WITH {RESULTS} SELECT row, __dataset, metric FROM results WHERE __dataset IN ('BUILDING', 'MACHINERY') AND __run IN (0, 1)")
def strip_filter(spark, d):
    return B.strip(results(spark, d), {"__dataset": ["BUILDING", "MACHINERY"], "__run": [0, 1]}, ["row", "__dataset", "metric"])


@query("strip_invert", f"WITH {RESULTS} SELECT row, __dataset, metric FROM results WHERE __dataset NOT IN ('BUILDING') AND __run NOT IN (2)")
def strip_invert(spark, d):
    return B.strip(results(spark, d), {"__dataset": ["BUILDING"], "__run": [2]}, ["row", "__dataset", "metric"], invert=True)


@query("merge_common", "SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def merge_common(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), "c_mktsegment")
    b = table(spark, d, "supplier").select("s_name", F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return B.merge_common(a, b)


@query("extend_outer", "SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment, NULL AS name FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL, s_name FROM supplier")
def extend_outer(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return B.extend(a, b)


@query("average_rows", f"WITH {RESULTS} SELECT __dataset, __method, 'averaged' AS __run, round(avg(metric), 4) AS metric, round(avg(time), 4) AS time FROM results GROUP BY __dataset, __method")
def average_rows(spark, d):
    out = B.average_rows(results(spark, d), ["__run"], ["metric", "time"])
    return out.select("__dataset", "__method", "__run", F.round("metric", 4).alias("metric"), F.round("time", 4).alias("time"))


_SPACE = {"__dataset": ["BUILDING", "MACHINERY", "FURNITURE", "NONE"], "__method": ["1-URGENT", "5-LOW"], "__run": [0, 1, 2]}


@query(
    "parameter_space",
    f"WITH {RESULTS} SELECT * FROM (SELECT DISTINCT __dataset FROM results), (SELECT DISTINCT __method FROM results), (SELECT DISTINCT __run FROM results) WHERE NOT (__dataset = 'FURNITURE' AND __run > 0)",
)
def parameter_space(spark, d):
    """All combinations of the values that a result table holds, but for some that don't go together."""
    return B.seen_settings(results(spark, d), list(_SPACE), "NOT (__dataset = 'FURNITURE' AND __run > 0)")


@query(
    "check_failures",
    f"""WITH {RESULTS}, e AS (SELECT * FROM (VALUES ('BUILDING'), ('MACHINERY'), ('FURNITURE'), ('NONE')) a(__dataset), (VALUES ('1-URGENT'), ('5-LOW')) b(__method), (VALUES (CAST(0 AS BIGINT)), (1), (2)) c(__run)),
    r AS (SELECT __dataset, __method, __run, count(*) AS n FROM results GROUP BY ALL) SELECT __dataset, __method, __run, coalesce(n, 0) AS found FROM e LEFT JOIN r USING (__dataset, __method, __run) WHERE coalesce(n, 0) <> 200""",
)
def check_failures(spark, d):
    return B.missing(B.expected_settings(_SPACE, spark), results(spark, d), list(_SPACE), 200)


@query(
    "completed_table",
    f"""WITH {RESULTS}, e AS (SELECT * FROM (VALUES ('BUILDING'), ('MACHINERY'), ('FURNITURE'), ('NONE')) a(__dataset), (VALUES ('1-URGENT'), ('5-LOW')) b(__method), (VALUES (CAST(0 AS BIGINT)), (1), (2)) c(__run)),
    r AS (SELECT __dataset, __method, __run, count(*) AS n FROM results GROUP BY ALL)
    SELECT __dataset, __method, __run, 'all' AS __study, CASE WHEN known IS NULL THEN n ELSE greatest(coalesce(n, 0), 200) END AS rows, CASE WHEN known IS NULL THEN 0 ELSE greatest(200 - coalesce(n, 0), 0) END AS filled
    FROM r FULL JOIN (SELECT *, 1 AS known FROM e) USING (__dataset, __method, __run)""",
)
def completed_table(spark, d):
    """Missing splits of expected settings are filled with a default; a further parameter is the same in all rows."""
    full = B.complete(results(spark, d).select(*_SPACE, "metric"), B.expected_settings(_SPACE, spark), list(_SPACE), 200, {"metric": -1.0})
    return B.add_key(full, "__study", "all").groupBy(*_SPACE, "__study").agg(F.count("*").alias("rows"), F.sum((F.col("metric") == -1).cast("long")).alias("filled"))


@query("analysis_cube", f"WITH {RESULTS} SELECT __dataset, __method, __run, round(avg(metric), 4) AS mean, count(*) AS n FROM results GROUP BY CUBE (__dataset, __method, __run)")
def analysis_cube(spark, d):
    return B.cube(results(spark, d), ["__dataset", "__method", "__run"], "metric").withColumn("mean", F.round("mean", 4))


@query("reduce_table", f"WITH {RESULTS} SELECT __method, __dataset, round(avg(metric), 4) AS metric FROM results GROUP BY __method, __dataset")
def reduce_table(spark, d):
    return B.reduce_table(results(spark, d), "__method", ["__dataset"], "metric").withColumn("metric", F.round("metric", 4))


@query(
    "variable_parameters",
    f"""WITH {RESULTS}, l AS (SELECT '__dataset' AS "column", CAST(__dataset AS VARCHAR) AS v FROM results UNION ALL SELECT '__method', __method FROM results UNION ALL SELECT '__run', CAST(__run AS VARCHAR) FROM results UNION ALL SELECT 'metric', CAST(metric AS VARCHAR) FROM results)
    SELECT "column", count(DISTINCT v) AS n_values, bool_and(try_cast(v AS DOUBLE) IS NOT NULL) AND count(DISTINCT v) >= 5 AS is_numeric FROM l GROUP BY 1""",
)
def variable_parameters(spark, d):
    return B.variable_parameters(results(spark, d), ["__dataset", "__method", "__run", "metric"])


@query("split_name", "SELECT p_partkey, split_part(p_name, ' ', 1) AS __colour, split_part(p_name, ' ', 2) AS __thing, split_part(p_name, ' ', 3) AS __more FROM part")
def split_name(spark, d):
    parts = B.split_name(table(spark, d, "part"), "p_name", ["colour", "thing", "more"], " ")
    return parts.select("p_partkey", *(F.coalesce(c, F.lit("")).alias(c) for c in ("__colour", "__thing", "__more")))


def _sets(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("set"), F.col("n_nationkey").cast("long").alias("item"), F.col("n_nationkey").cast("double").alias("start_ms"), (F.col("n_nationkey") + 1.0).alias("end_ms"))
    return rows.select("set").distinct(), rows


@query("all_vs_one", "SELECT CAST(a.r_regionkey AS BIGINT) AS target, CAST(n_regionkey AS BIGINT) AS \"set\", CASE WHEN a.r_regionkey = n_regionkey THEN 'test' ELSE 'train' END AS side, CAST(n_nationkey AS BIGINT) AS item FROM region a, nation")
def all_vs_one(spark, d):
    sets, rows = _sets(spark, d)
    return B.all_vs_one(sets, rows, "set").select("target", "set", "side", "item")


@query("pairwise_sets", "SELECT CAST(a.r_regionkey AS BIGINT) AS train, CAST(b.r_regionkey AS BIGINT) AS test FROM region a, region b WHERE a.r_regionkey <> b.r_regionkey")
def pairwise_sets(spark, d):
    return B.pairs_of_sets(_sets(spark, d)[0], "set")


@query(
    "concatenate_shift",
    """WITH r AS (SELECT CAST(n_regionkey AS BIGINT) AS "set", CAST(n_nationkey AS BIGINT) AS item, CAST(n_nationkey AS DOUBLE) AS a, n_nationkey + 1.0 AS b FROM nation),
    e AS (SELECT "set", coalesce(sum(m) OVER (ORDER BY "set" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM (SELECT "set", max(b) AS m FROM r GROUP BY "set"))
    SELECT "set", item, CAST(a + shift AS DOUBLE) AS start_ms, CAST(b + shift AS DOUBLE) AS end_ms FROM r JOIN e USING ("set")""",
)
def concatenate_shift(spark, d):
    return B.concatenate(_sets(spark, d)[1], "set", "start_ms", "end_ms")


@query(
    "paired_ttest",
    f"""WITH {RESULTS}, p AS (SELECT __method AS m, __dataset AS s, __run AS r, avg(metric) AS v FROM results GROUP BY ALL), n AS (SELECT count(DISTINCT m) AS n FROM p),
    x AS (SELECT a.m AS a, b.m AS b, a.v AS va, b.v AS vb, a.v - b.v AS diff FROM p a JOIN p b ON a.s = b.s AND a.r = b.r AND a.m > b.m)
    SELECT a, b, count(*) AS k, round(avg(diff), 4) AS mean_diff, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) AS t, round(corr(va, vb), 6) AS correlation, round(0.05 / min(n), 8) AS bonferroni, round(1 - power(0.95, 1.0 / min(n)), 8) AS sidak FROM x, n GROUP BY a, b""",
)
def paired_ttest(spark, d):
    out = B.paired_statistics(results(spark, d), "__method", ["__dataset", "__run"], "metric")
    return out.select("a", "b", "k", F.round("mean_diff", 4).alias("mean_diff"), F.round("t", 6).alias("t"), F.round("correlation", 6).alias("correlation"), F.round("bonferroni", 8).alias("bonferroni"), F.round("sidak", 8).alias("sidak"))


@query("metric_histogram", f"WITH {RESULTS} SELECT CAST(least(floor(metric / 25000), 19) AS BIGINT) AS bin, count(*) AS n FROM results GROUP BY 1")
def metric_histogram(spark, d):
    return results(spark, d).groupBy(F.least(F.floor(F.col("metric") / 25000), F.lit(19)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
