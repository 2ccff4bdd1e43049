"""Models that go on learning from a stream: self-training, by sums.

The state is the sums of each class's rows (d x d numbers), whatever the length of the stream. It is written once for each
batch number, so a batch that is run again after a failure starts from the same state and ends in the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.operators import learners as L
from sigmill.operators import models as D

_NAME = "self"


def confident(scored: DataFrame, positive: str, negative: str, boundary: float, confidence: float, score: str = "score", label: str = "own_label") -> DataFrame:
    """Rows further than confidence from the decision boundary, with the label that this gives them."""
    return scored.filter(F.abs(F.col(score) - boundary) > confidence).withColumn(label, F.when(F.col(score) > boundary, positive).otherwise(negative))


def self_train(stream: DataFrame, start: D.Model, vector: str, root: str, boundary: float = 0.0, confidence: float = 0.0):
    """Starts the query; each batch is scored with the model so far (to root/predictions), then its confident rows are added
    to the model's sums under their own predicted labels (to root/models), and the next batch meets the model solved anew."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        model = start if number == 0 else D.load(spark, f"{root}/models/batch={number - 1}")[0]
        with L.kept(batch):
            scored = batch.withColumn("score", model.score(vector))
            scored.write.mode("overwrite").parquet(f"{root}/predictions/batch={number}")
            own = confident(scored, model.positive, model.negative, boundary, confidence)
            D.save(spark, [model.adapted(L.moments(own, "own_label", vector))], f"{root}/models/batch={number}", "overwrite")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def last_model(spark: SparkSession, root: str) -> D.Model:
    """The model after the last batch."""
    newest = spark.read.parquet(f"{root}/models").agg(F.max("batch")).first()[0]
    return D.load(spark, f"{root}/models/batch={newest}")[0]
