"""Streaming queries, run over a table's files until all is read; their SQL is the batch result."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.functions.expr import r6
from sigmill.plans.inputs import table
from sigmill.plans.query import query
from sigmill.streaming import live as V


@cache
def _own_folder() -> str:
    own = tempfile.mkdtemp(prefix="sigmill-")
    atexit.register(shutil.rmtree, own, True)
    return own


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session may lack it: it then gets a folder of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"file://{_own_folder()}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(d)
    return stream.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")


def _to_table(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs the stream over what is there and returns the last result."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")  # complete mode: each batch is the whole result

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    newest = q.lastProgress["batchId"] if q.lastProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{root}/out/batch={newest}")


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
)
def stream_sessions(spark, d):
    """Trials of a live stream: runs of events with less than 12 hours between them."""
    out = _to_table(spark, V.sessions(_events(spark, d), ["user_id"], "ts", "12 hours"), "complete")
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


@query("stream_predictions", "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS predicted FROM events")
def stream_predictions(spark, d):
    """A model applied to each batch of a live stream; the predictions are appended to a table."""
    root = f"{shared_folder(spark)}/predict-{uuid.uuid4().hex}"
    model = lambda batch: batch.select("event_id", F.when(F.col("value") > 50, "high").otherwise("low").alias("predicted"))
    V.predict(_events(spark, d), model, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("event_id", "predicted")


@query(
    "stream_window_means",
    "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(value) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_pop(value), 6) + 0.0 AS sd FROM events GROUP BY 1, 2",
)
def stream_window_means(spark, d):
    out = V.window_means(_events(spark, d), ["event_type"], "ts", "value", "1 hour")
    out = _to_table(spark, out, "complete")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", r6("mean").alias("mean"), r6("sd").alias("sd"))
