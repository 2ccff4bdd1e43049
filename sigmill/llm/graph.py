"""Connected components as joins, for graphs whose links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm.workspace import Workspace


def components(links: DataFrame, ws: Workspace, name: str, rows: int | None = None, rounds: int = 60) -> DataFrame:
    """node, label for every node of links(u, v): label is the smallest node of its component. rows: about as many links.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), each one aggregation and one join, until
    every node points at its label. Each round is written as a table and the one before it is dropped.
    """
    pairs = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    at = ws.write(pairs(links), f"{name}-0", rows)
    size = at.count()
    for k in range(1, rounds + 1):
        # the smallest neighbours are written first: a join of two plain shuffles is one whose hot nodes Spark can split
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ws.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-{k}m", 2 * size)
        large = ws.write(pairs(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), f"{name}-{k}a", size)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        after = ws.write(pairs(small), f"{name}-{k}", 2 * size)
        # done when no node points at two, and none that is pointed at points on
        ends = after.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(after.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        open_ = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR (out > 0 AND in > 0)")
        done = open_.agg(F.count("*")).first()[0] == 0
        ws.drop(f"{name}-{k}a", f"{name}-{k}m", f"{name}-{k - 1}")
        at, size = after, 2 * size
        if done:
            break
        size = at.count()
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    labels = at.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out = ws.write(labels, name, 2 * size)
    ws.drop(f"{name}-{k}")
    return out
