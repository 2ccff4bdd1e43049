"""The test tables in the roles of the engine's data model, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.operators.segments import numbered

WINDOW = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream for each user: user_id, t (index), event_id, marker, value."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("marker"), "value")
    return numbered(events, ["user_id"], F.date_trunc("day", "ts"), ["ts", "event_id"]).drop("ts")


SAMPLES = "samples AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, event_id, event_type AS marker, value FROM events)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams cut in windows of WINDOW samples: user_id, win, k (index in the window), marker, value."""
    return samples(spark, sf_dir).select("user_id", F.floor(F.col("t") / WINDOW).alias("win"), (F.col("t") % WINDOW).alias("k"), "marker", "value")


WINDOWS = f"{SAMPLES}, windows AS (SELECT user_id, CAST(t // {WINDOW} AS BIGINT) AS win, t % {WINDOW} AS k, marker, value FROM samples)"

CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ROW = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four channels in wide form, one window for each order: win, t, label and the channels."""
    t = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ROW)).cast("long")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("win"), t.alias("t"), F.col("l_returnflag").alias("label"), *CHANNELS)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in long form: win, t, label, channel, value."""
    return records(spark, sf_dir).unpivot(["win", "t", "label"], CHANNELS, "channel", "value")


RECORDS = f"records AS (SELECT l_orderkey AS win, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ROW)}) AS BIGINT) AS t, l_returnflag AS label, {', '.join(CHANNELS)} FROM lineitem)"
CHANNEL_SQL = f"{RECORDS}, channels AS (" + " UNION ALL ".join(f"SELECT win, t, label, '{c}' AS channel, {c} AS value FROM records" for c in CHANNELS) + ")"


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature vectors in long form: id, label, f (index), x."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("f", "x")).select("id", "label", F.col("f").cast("long").alias("f"), F.col("x").cast("double").alias("x"))


FEATURES = "features AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS f, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, truth (quality), score and predicted, in five folds: a fixed linear score of length and toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = (F.col("n_chars") % 1000) / 500.0 - 1 + F.when(F.col("quality") == 1, 0.4).otherwise(-0.4)
    out = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 5).alias("fold"), F.col("quality").cast("long").alias("truth"), F.round(score, 6).alias("score"))
    return out.withColumn("predicted", (F.col("score") > 0).cast("long"))


PREDICTIONS = "predictions AS (SELECT *, CASE WHEN score > 0 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS predicted FROM (SELECT l.doc_id AS id, l.doc_id % 5 AS fold, CAST(quality AS BIGINT) AS truth, round((n_chars % 1000) / 500.0 - 1 + CASE WHEN quality = 1 THEN 0.4 ELSE -0.4 END, 6) AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id))"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A performance table: __dataset, __method, __run, metric columns."""
    orders, cust = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("__dataset"), F.col("o_orderpriority").alias("__method"), (F.col("o_orderkey") % 3).alias("__run"), F.col("o_totalprice").alias("metric"), F.col("c_acctbal").alias("time"), F.col("o_orderkey").alias("row"))


RESULTS = "results AS (SELECT c_mktsegment AS __dataset, o_orderpriority AS __method, o_orderkey % 3 AS __run, o_totalprice AS metric, c_acctbal AS time, o_orderkey AS row FROM orders JOIN customer ON o_custkey = c_custkey)"
