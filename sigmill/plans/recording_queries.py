"""Queries of recordings and traces, written from the tables and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sigmill.functions.expr import rounded
from sigmill.plans.inputs import PREDICTIONS, predictions, table
from sigmill.plans.query import query
from sigmill.plans.stream_queries import shared_folder
from sigmill.sources import files, recordings


def _written(spark, d) -> str:
    path = f"{shared_folder(spark)}/recording-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.col("event_id").alias("t"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("S "), "event_type")).alias("marker"), rounded("value", 1).alias("C3"), (F.col("user_id") % 100).cast("double").alias("C4"))
    recordings.write(e, path, 250.0, pieces=4, resolution=0.02)
    return path


@query("recording_samples", "SELECT event_id AS t, 'C3' AS channel, round(value, 1) AS value FROM events UNION ALL SELECT event_id, 'C4', CAST(user_id % 100 AS DOUBLE) FROM events")
def recording_samples(spark, d):
    """A multichannel recording written by several tasks as pieces, and read in ranges of records."""
    samples, _ = recordings.read(spark, _written(spark, d), 1 << 14)
    return samples.select("t", "channel", rounded("value", 1).alias("value"))


@query("recording_markers", "SELECT event_id AS t, round(event_id / 250.0::DOUBLE, 6) AS seconds, 'S ' || event_type AS marker FROM events WHERE event_id % 3 = 0")
def recording_markers(spark, d):
    """Its markers."""
    _, markers = recordings.read(spark, _written(spark, d))
    return markers.select("t", F.round("seconds", 6).alias("seconds"), "marker")


@query("merged_traces", f"WITH {PREDICTIONS} SELECT id, truth, score, id % 2 AS __run, fold AS __fold, 'toy' AS __name, CASE WHEN id % 2 = 0 THEN '1' ELSE '10' END AS __complexity FROM predictions")
def merged_traces(spark, d):
    """Traces of two runs and five folds, many small files in folders by run and fold, as one table."""
    root = f"{shared_folder(spark)}/traces-{uuid.uuid4().hex}"
    p = predictions(spark, d)
    for run, complexity in ((0, 1), (1, 10)):
        for fold in range(5):
            p.filter((F.col("id") % 2 == run) & (F.col("fold") == fold)).select("id", "truth", "score").write.json(f"{root}/toy_{complexity}/persistency_run{run}/features/trace_sp{fold}")
    out = files.merge_traces(spark, root, "id long, truth long, score double", ["name", "complexity"])
    return out.select("id", "truth", "score", "__run", "__fold", "__name", "__complexity")
