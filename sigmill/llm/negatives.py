"""Hard negatives of anchors by an exact nearest-neighbour join over Voronoi cells.

Vectors are made integers, and a row x is put at (x, sqrt(M - |x|^2)), M being the largest squared length of all rows; an
anchor a stands at (a, 0). The squared distance of the two is |a|^2 + M - 2 <a, x>, so rows near an anchor are those with a
high inner product, and inner products between two bounds are distances between two others.

1. Pivots are fitted on a bounded sample of rows (the ``SAMPLE`` with the smallest hashes): a few steps of k-means from a
   random choice; there are about one for each ``CELL_ANCHORS`` anchors, ``MOST_PIVOTS`` at most. Each row and each anchor
   goes to the cell of its nearest pivot.
2. Each anchor is joined with the rows of its own cell, which bounds how far its result can reach.
3. A row of another cell is sent to an anchor's cell only if it might serve an anchor there: the row's distance from the
   cell's pivot, less the anchor's own, may not exceed the reach, nor may its distance from the hyperplane between the two
   cells. The reaches of a cell are kept by label, as positives have their anchor's label.
4. There it is compared exactly, as integers, and what is as good as the anchor's last result so far is kept.

This is done twice: for the positives, and for the negatives, where each anchor and positive ask for a range of inner
products, so a cell has a least and a greatest distance.

A cell's rows are dealt into tiles of about ``TILE_ROWS``, its anchors into groups of ``TILE_ANCHORS``; a task joins one
group with one tile, so neither a hot cell, a hot label nor many copies of one vector meet in one task. Every row is
compared with all the anchors that its distance leaves; in vectors without clusters that is most of them, as in any exact
join. What tasks share is bounded by the number of pivots.

Defined results: rows with a null label or vector, or with a null, NaN or infinite component, take no part; nor do those
whose integer vector has a squared length of 2**55 or more, so that 64 bits hold all products and their hundredfold; components beyond the end of
a shorter vector are 0; an empty vector is 0; rows are told apart by the row, not the id, so a repeated row is another row,
and a repeated anchor is answered twice; a row without an id is no anchor and comes last among equal scores, its label as it
is; an anchor without positives, and a positive without negatives in range, have no rows; an empty table gives none; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm import text as tx
from sigmill.llm.workspace import Workspace, table

POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
SCALE = 256
SAMPLE, MOST_PIVOTS, CELL_ANCHORS = 4096, 256, 64
TILE_ROWS, TILE_ANCHORS = 2048, 256
STEPS = 5
MOST_LENGTH = 1 << 55
NO_ID = np.iinfo(np.int64).max


def integers(rows: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """id, label, v, size (squared length) of the rows that take part; label is any expression."""
    v = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))))
    fine = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) * SCALE >= 2.0**31))
    some = rows.select(F.col(vec_id).cast("long").alias("id"), F.expr(label).cast("string").alias("label"), F.when(fine, v).cast("array<int>").alias("v"))
    size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    some = some.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(size < float(MOST_LENGTH))
    return some.withColumn("size", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x.cast("long") * x.cast("long")))


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """Integer vectors as rows, shorter ones filled up with 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.list_(pa.int32()))
    at = np.asarray(column.offsets).astype(np.int64)
    out = np.zeros((len(column), dims), np.int64)
    n = np.diff(at)
    out[np.repeat(np.arange(len(n)), n), tx.spread(n)] = np.asarray(column.values)[at[0] : at[-1]]
    return out


class Space:
    """The pivots, and distances from them."""

    def __init__(self, dims: int, most: int, sample: np.ndarray, size: np.ndarray, pivots: int):
        self.dims, self.most = dims, most
        points = np.unique(self.place(sample, size), axis=0) if len(sample) else np.zeros((1, dims + 1))
        rng = np.random.default_rng(11)
        self.pivots = points[rng.choice(len(points), min(pivots, len(points)), replace=False)]
        for _ in range(STEPS):
            near = self.distances(points).argmin(1)
            self.pivots = np.stack([points[near == k].mean(0) if (near == k).any() else p for k, p in enumerate(self.pivots)])
        self.apart = np.sqrt(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(2))

    def place(self, v: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.most - size, 0))]).astype(np.float64)

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    @property
    def slack(self) -> float:
        """More than rounding can take from a distance."""
        return 1e-6 * np.sqrt(4.0 * self.most + 1) + 1e-3

    def assign(self, rows: DataFrame) -> DataFrame:
        """cell of each row, and for anchors home and off: the cell of the anchor, and its distance from the pivot."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v, size = matrix(b.column("v"), self.dims), np.asarray(b.column("size"))
                cell = self.distances(self.place(v, size)).argmin(1)
                from_here = self.distances(np.column_stack([v, np.zeros(len(v))]).astype(np.float64))
                home = from_here.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(home, pa.int32()), pa.array(from_here[np.arange(len(v)), home], pa.float64())], names=[*b.schema.names, "cell", "home", "off"])

        return rows.mapInArrow(run, f"{_columns(rows)}, cell int, home int, off double")

    def sent(self, rows: DataFrame, tiles: list[int], own: bool) -> DataFrame:
        """Rows with the columns at (a cell of anchors that they may serve) and tile. own: each to its own cell only;
        otherwise to the others, by the columns cells, near and far: which cells there are, and the distances from anchors
        there that are asked for."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            deal = np.maximum(np.asarray(tiles), 1)
            for b in batches:
                cell, row = np.asarray(b.column("cell")), np.asarray(b.column("row"))
                if own:
                    who, at = np.arange(b.num_rows), cell
                else:
                    lists = [b.column(x) for x in ("cells", "near", "far", "off_most")]
                    n = np.asarray(lists[0].value_lengths()).astype(np.int64)
                    flat = [np.asarray(x.flatten()) for x in lists]
                    who, at = np.repeat(np.arange(b.num_rows), n), flat[0]
                    away = self.distances(self.place(matrix(b.column("v"), self.dims), np.asarray(b.column("size"))))
                    to, mine = away[who, at], away[who, cell[who]]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        plane = np.where(self.apart[at, cell[who]] > 0, (to**2 - mine**2) / (2 * self.apart[at, cell[who]]), 0)
                    least = np.maximum(to - flat[3], plane)
                    fit = (at != cell[who]) & (least <= flat[2] + self.slack) & (to + flat[3] >= flat[1] - self.slack)
                    who, at = who[fit], at[fit]
                tile = (tx.mix(row[who].astype(np.uint64)) % deal[at].astype(np.uint64)).astype(np.int32)
                rest = b.select(["row", "id", "label", "v"]).take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(at, pa.int32()), pa.array(tile, pa.int32())], names=[*rest.schema.names, "at", "tile"])

        return rows.mapInArrow(run, "row bigint, id bigint, label string, v array<int>, at int, tile int")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def products(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Inner products; by floating point where that is exact."""
    if most < 1 << 53:  # by Cauchy and Schwarz no partial sum is longer
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def first(score: np.ndarray, ids: np.ndarray, lost: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the best scores in order, equal ones by id, those without one last."""
    if len(score) > most:
        least = np.partition(score, len(score) - most)[len(score) - most]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((row[some], ids[some], lost[some], -score[some]))][:most]


def positives_of(dims: int, most: int, wanted: int):
    """anchors (row, label, v, least) and rows of one tile to an anchor's best rows of its label, as good as least."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, x = left.to_pydict(), right
        score = products(matrix(left["v"], dims), matrix(x["v"], dims), most)
        label, row, ids = np.asarray(x["label"].to_pylist(), object), np.asarray(x["row"]), np.asarray(x["id"].fill_null(NO_ID))
        lost = np.asarray(x["id"].is_null())
        by_label = {k: np.flatnonzero(label == k) for k in set(a["label"])}
        who, what, value = [], [], []
        for k, (anchor, own, least) in enumerate(zip(a["row"], a["label"], a["least"])):
            some = by_label[own]
            some = some[row[some] != anchor]
            if least is not None:
                some = some[score[k, some] >= least]
            best = some[first(score[k, some], ids[some], lost[some], row[some], wanted)]
            who += [anchor] * len(best)
            what += best.tolist()
            value += score[k, best].tolist()
        return pa.table({"anchor": pa.array(who, pa.int64()), "row": pa.array(row[what] if what else [], pa.int64()), "id": x["id"].take(pa.array(what, pa.int64())), "score": pa.array(value, pa.int64())})

    return run


def negatives_of(dims: int, most: int, wanted: int):
    """anchors (row, label, v, asks: place, low, high) and rows of one tile to the best rows of other labels for each ask."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, x = left.to_pydict(), right
        score = products(matrix(left["v"], dims), matrix(x["v"], dims), most)
        label, row, ids = np.asarray(x["label"].to_pylist(), object), np.asarray(x["row"]), np.asarray(x["id"].fill_null(NO_ID))
        lost = np.asarray(x["id"].is_null())
        other = {k: label != k for k in set(a["label"])}
        who, place, what, value = [], [], [], []
        for k, (anchor, own, asks) in enumerate(zip(a["row"], a["label"], a["asks"])):
            for ask in asks:
                some = np.flatnonzero(other[own] & (score[k] >= ask["low"]) & (score[k] <= ask["high"]))
                best = some[first(score[k, some], ids[some], lost[some], row[some], wanted)]
                who += [anchor] * len(best)
                place += [ask["place"]] * len(best)
                what += best.tolist()
                value += score[k, best].tolist()
        return pa.table({"anchor": pa.array(who, pa.int64()), "place": pa.array(place, pa.int32()), "row": pa.array(row[what] if what else [], pa.int64()), "id": x["id"].take(pa.array(what, pa.int64())), "score": pa.array(value, pa.int64())})

    return run


def best(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first rows of each key by score, id and row, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, ws: Workspace, anchor: str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = MOST_PIVOTS, cell_anchors: int = CELL_ANCHORS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor: condition on id of the rows to be anchors. label: expression for the label. A negative's score is within low
    and high hundredths of the positive's."""
    whole = ws.write(integers(rows, vec_id, vector, label).withColumn("row", F.monotonically_increasing_id()), "rows")
    is_anchor = f"id IS NOT NULL AND ({anchor})"
    n, anchors, most, dims = whole.agg(F.count("*"), F.count(F.expr(f"CASE WHEN {is_anchor} THEN 1 END")), F.coalesce(F.max("size"), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sample = whole.select("v", "size").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    space = Space(dims, most, matrix(sample["v"], dims), np.asarray(sample["size"]), max(1, min(pivots, -(-anchors // cell_anchors))))
    whole = ws.write(space.assign(whole), "cells")
    ws.drop("rows")
    asking = whole.filter(is_anchor).select("row", "id", "label", "v", "size", "home", "off")

    # a row for each pivot at most
    cells = len(space.pivots)
    tiles, groups = [1] * cells, [1] * cells
    for c, k in whole.groupBy("cell").count().collect():
        tiles[c] = -(-k // tile_rows)
    for c, k in asking.groupBy("home").count().collect():
        groups[c] = -(-k // TILE_ANCHORS)
    count_of = lambda counts, c: F.array(*(F.lit(x) for x in counts))[F.col(c)]

    def joined(anchors_: DataFrame, sent: DataFrame, run, schema: str) -> DataFrame:
        """Each group of a cell's anchors with each tile of the rows sent there."""
        left = anchors_.withColumn("at", F.col("home")).withColumn("group", F.pmod(F.xxhash64("row"), count_of(groups, "home")).cast("int")).withColumn("tile", F.explode(F.sequence(F.lit(0), count_of(tiles, "home") - 1)))
        right = sent.withColumn("group", F.explode(F.sequence(F.lit(0), count_of(groups, "at") - 1)))
        keys = ["at", "group", "tile"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_both(run, schema), schema)

    # positives
    schema = "anchor bigint, row bigint, id bigint, score bigint"
    base = asking.select("row", "label", "v", "home", F.lit(None).cast("long").alias("least"))
    near = ws.write(best(joined(base, space.sent(whole, tiles, True), positives_of(dims, most, positives), schema), ["anchor"], positives), "near")
    kth = near.filter(F.col("rank") == positives).select(F.col("anchor").alias("row"), F.col("score").alias("least"))
    told = asking.join(kth, "row", "left")
    reach = F.sqrt(F.greatest(F.col("size") + F.lit(most) - 2 * F.col("least"), F.lit(0)).cast("double"))
    told = ws.write(told.withColumn("far", F.when(F.col("least").isNull(), F.lit(float("inf"))).otherwise(reach)), "told")
    bounds = told.groupBy("label", "home").agg(F.max("far").alias("far"), F.max("off").alias("off"))
    lists = bounds.groupBy("label").agg(F.sort_array(F.collect_list(F.struct(F.col("home").alias("c"), "far", "off"))).alias("b"))  # a cell each
    asked = whole.join(lists, "label").select("row", "id", "label", "v", "size", "cell", F.col("b.c").alias("cells"), F.transform("b", lambda x: F.lit(0.0)).alias("near"), F.col("b.far").alias("far"), F.col("b.off").alias("off_most"))
    more = joined(told.select("row", "label", "v", "home", "least"), space.sent(asked, tiles, False), positives_of(dims, most, positives), schema)
    found = ws.write(best(near.drop("rank").unionByName(more), ["anchor"], positives), "positives")

    # negatives: low * positive <= 100 * score <= high * positive, in integers
    asks = found.filter("score >= 0").select(F.col("anchor").alias("row"), F.col("rank").alias("place"), F.ceil(F.expr(f"({low} * score + 99) DIV 100")).alias("low"), F.expr(f"({high} * score) DIV 100").alias("high")).filter("low <= high")
    by_anchor = lambda a: a.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("asks"))  # noqa: E731  one for each positive
    schema = "anchor bigint, place int, row bigint, id bigint, score bigint"
    asking = ws.write(asking.join(by_anchor(asks), "row"), "asking")
    home = joined(asking.select("row", "label", "v", "home", "asks"), space.sent(whole, tiles, True), negatives_of(dims, most, negatives), schema)
    near = ws.write(best(home, ["anchor", "place"], negatives), "near-negatives")
    kth = near.filter(F.col("rank") == negatives).select(F.col("anchor").alias("row"), "place", F.col("score").alias("kth"))
    asks = asks.join(kth, ["row", "place"], "left").withColumn("low", F.greatest("low", "kth")).drop("kth")
    told = ws.write(asking.drop("asks").join(by_anchor(asks), "row"), "told-negatives")
    away = lambda s: F.sqrt(F.greatest(F.col("size") + F.lit(most) - 2 * s, F.lit(0)).cast("double"))
    bounds = told.groupBy("home").agg(F.min(away(F.array_max("asks.high"))).alias("near"), F.max(away(F.array_min("asks.low"))).alias("far"), F.max("off").alias("off")).collect()  # a cell each
    of = sorted((r["home"], r["near"], r["far"], r["off"]) for r in bounds)
    column = lambda k, kind: F.array(*(F.lit(r[k]) for r in of)).cast(f"array<{kind}>")
    asked = whole.select("row", "id", "label", "v", "size", "cell", column(0, "int").alias("cells"), column(1, "double").alias("near"), column(2, "double").alias("far"), column(3, "double").alias("off_most"))
    more = joined(told.select("row", "label", "v", "home", "asks"), space.sent(asked, tiles, False), negatives_of(dims, most, negatives), schema)
    chosen = best(near.drop("rank").unionByName(more), ["anchor", "place"], negatives)

    named = found.join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor").select("anchor", F.col("rank").alias("place"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = chosen.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = ws.write(out, "result")
    ws.drop("cells", "near", "told", "positives", "asking", "near-negatives", "told-negatives")
    return out


def _both(run, schema: str):
    """run, where a key has both sides."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def on(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right) if left.num_rows and right.num_rows else empty

    return on


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    return mine(table(spark, sf_dir, "embeddings"), Workspace(spark, "op11"), "id % 100 = 0", label=moved)


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(len(v))) AS i FROM e),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM c a JOIN c b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 GROUP BY a.vec_id, b.vec_id, a.label, b.label),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM s WHERE same) WHERE nth <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
