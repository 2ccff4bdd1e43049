"""Ranked lexical search with variable-sized blocks and their maxima (variable block-max WAND).

Documents are cut into shards of about ``SHARD_BYTES`` of text. One pass makes the index of a set of queries: for each
shard a row with the posting lists (document and frequency, by term) of the terms that the queries hold, and what the
whole corpus has to add up (documents, words, documents with a term). A second pass searches shard by shard:

* the boundaries of each posting list's blocks come from a dynamic program: of all ways to cut the list into blocks of at
  most ``LONGEST`` postings, the one with the least sum of (block maximum - score) over all postings and ``PENALTY`` mean
  scores for each block. All lists of a shard advance through it together, a posting at a time;
* between two neighbouring block boundaries of a query's terms, the sum of the maxima of the blocks there bounds every
  document's score; documents between the blocks of a list get nothing from it. Where the bound is under the score of the
  query's last result so far, the whole stretch is skipped and no posting in it is read;
* the other stretches are taken in order of their bounds, few at first, so that the last result's score soon rises. Of
  their documents those are candidates that pass WAND's pivot test: lists whose greatest scores add up to less than is
  needed bring in none, and are looked up only for the candidates of the other lists, which are scored exactly. A bound
  equal to what is needed isn't skipped, since a smaller id would win the tie.

A task keeps the first ``top`` results of each query over all its shards; these meet by query, in two steps.

Queries come in blocks of about ``BLOCK_TERMS`` distinct terms; a block is on the driver and sent to the executors, the
next one is further passes. Scores are integers throughout, so results don't depend on how the corpus is cut.

Defined results: null or empty text, or one without terms, is no document and never a result, and an item without terms
has no results; equal scores go by id, a row without one last; repeated rows are documents of their own; each row of the
queries is an item of its own, with a null id too; empty tables give no rows; other columns aren't read. Ids of documents
are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm import text as tx
from sigmill.llm.workspace import Workspace, table

TOP = 10
SHARD_BYTES = 8 << 20
BLOCK_TERMS = 200_000
LONGEST, PENALTY = 64, 3.0
SALTS = 64
NO_ID = np.iinfo(np.int64).max


@dataclass
class Queries:
    """A block of queries: their distinct terms, and for each its number, id, terms (as indices) and how often it has each."""

    terms: list[str] = field(default_factory=list)
    items: list[tuple[int, object, np.ndarray, np.ndarray]] = field(default_factory=list)


def blocks(queries: DataFrame, item: str, text: str, most: int) -> Iterator[Queries]:
    """All queries that have terms, in blocks of about most distinct terms; a block is made when it is asked for."""
    place: dict[str, int] = {}
    block, number = Queries(), 0
    for row in queries.select(F.col(item), text).filter(F.col(text).isNotNull()).toLocalIterator():
        w = tx.words(pa.array([row[1]], pa.string()), tx.ALNUM)
        if len(w.codes):
            own = np.array([place.setdefault(t, len(place)) for t in w.vocab.to_pylist()])
            codes, counts = np.unique(own[w.codes], return_counts=True)
            block.items.append((number, row[0], codes, counts))
            number += 1
        if len(place) >= most:
            block.terms, place = list(place), {}
            yield block
            block = Queries()
    if block.items:
        block.terms = list(place)
        yield block


INDEX = "ids array<bigint>, n array<bigint>, term array<int>, start array<bigint>, doc array<int>, tf array<bigint>, docs bigint, words bigint"


def _lists(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def indexer(block: Broadcast):
    """A row for each shard: its documents with terms, their lengths, and posting lists of the block's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(block.value.terms, pa.string())
        for b in tx.slices(batches, "text", SHARD_BYTES):
            w = tx.words(b.column("text"), tx.ALNUM)
            has = w.n > 0
            if not has.any():
                continue
            place = np.cumsum(has) - 1  # of a row among the documents
            known = np.asarray(pc.index_in(w.vocab, wanted).fill_null(-1)).astype(np.int64)[w.codes]
            own = known >= 0
            size = int(has.sum())
            key, tf = np.unique(known[own] * size + place[w.rows()[own]], return_counts=True)
            term, start = np.unique(key // size, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [
                    _lists(b.column("doc_id").filter(pa.array(has)).cast(pa.int64()), pa.int64()),
                    _lists(w.n[has], pa.int64()),
                    _lists(term, pa.int32()),
                    _lists(np.append(start, len(key)), pa.int64()),
                    _lists(key % size, pa.int32()),
                    _lists(tf, pa.int64()),
                    pa.array([size], pa.int64()),
                    pa.array([len(w.codes)], pa.int64()),
                ],
                names=["ids", "n", "term", "start", "doc", "tf", "docs", "words"],
            )

    return run


def frequencies(index: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each term of the block is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(terms, np.int64)
        for b in batches:
            for term, start in zip(b.column("term"), b.column("start")):
                df[np.asarray(term.values)] += np.diff(np.asarray(start.values))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(df[used], pa.int64())], names=["term", "df"])

    out = np.zeros(terms, np.int64)
    for term, df in index.select("term", "start").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df")).collect():  # terms of one block
        out[term] = df
    return out


def cuts(scores: np.ndarray, start: np.ndarray, longest: int = LONGEST, penalty: float = PENALTY) -> np.ndarray:
    """Where blocks begin in posting lists scores[start[i]:start[i + 1]], each of one posting or more: the cut of least
    total (block maximum - score), with penalty mean scores for each block."""
    n = np.diff(start)
    order = np.argsort(-n, kind="stable")
    n, at = n[order], start[:-1][order]
    each = penalty * tx.sums(scores.astype(np.float64), start)[order] / np.maximum(n, 1)
    ring = min(longest, int(n[0])) if len(n) else 1
    top, before = np.zeros((len(n), ring)), np.full((len(n), ring), np.inf)
    best = np.zeros(len(n))  # of all up to the posting before
    origin = np.empty(len(scores), np.int64)  # where the last block of the best cut up to here begins, within the list
    slots = np.arange(ring)
    for i in range(int(n[0]) if len(n) else 0):
        k = int(np.searchsorted(-n, -i, "left"))  # lists with more than i postings
        now = scores[at[:k] + i].astype(np.float64)
        np.maximum(top[:k], now[:, None], out=top[:k])
        top[:k, i % ring], before[:k, i % ring] = now, best[:k]
        size = (i - slots) % ring + 1
        cost = top[:k] * size + before[:k]
        if i + 1 < ring:
            cost[:, i + 1 :] = np.inf
        choice = np.argmin(cost, 1)
        best[:k] = cost[np.arange(k), choice] + each[:k]
        origin[at[:k] + i] = i + 1 - size[choice]
    begins = np.zeros(len(scores), bool)
    here, base = n - 1, at
    while len(here):
        first = origin[base + here]
        begins[base + first] = True
        on = first > 0
        here, base = first[on] - 1, base[on]
    return np.flatnonzero(begins)


class Shard:
    """Posting lists of a shard with their scores (without the term's weight) and blocks."""

    def __init__(self, row: dict, corpus_docs: int, corpus_words: int):
        flat = {k: np.asarray(row[k].values) for k in ("n", "term", "start", "doc", "tf")}
        ids = row["ids"].values
        self.no_id = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(NO_ID))
        self.size, self.term, self.start, self.doc = len(self.ids), flat["term"], flat["start"], flat["doc"].astype(np.int64)
        m = 25 + (75 * flat["n"] * corpus_docs) // corpus_words
        self.score = (1_000_000_000 * flat["tf"]) // (1000 * flat["tf"] + 8 * m[self.doc])
        self.block = cuts(self.score, self.start)
        end = np.append(self.block[1:], len(self.score))[: len(self.block)]
        self.first, self.after = self.doc[self.block], self.doc[end - 1] + 1 if len(end) else end
        self.most = np.maximum.reduceat(self.score, self.block) if len(self.block) else self.score
        self.blocks = np.searchsorted(self.block, self.start)

    def stretches(self, lists: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Between which documents [a, b) no block of the lists begins or ends, and the bound of scores there; without those
        where no block is."""
        own = [slice(self.blocks[x], self.blocks[x + 1]) for x in lists]
        gain = np.concatenate([self.most[s] * x for s, x in zip(own, weight)])
        place = np.concatenate([self.first[s] for s in own] + [self.after[s] for s in own])
        order = np.argsort(place)
        place, bound = place[order], np.cumsum(np.concatenate([gain, -gain])[order])
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True))
        a, bound = place[last], bound[last]
        live = np.flatnonzero(bound[:-1] > 0)
        return a[live], a[live + 1], bound[live]

    def scores(self, lists: np.ndarray, weight: np.ndarray, needed: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of the stretches that can score needed or more, and what they score. Lists whose greatest scores
        add up to less don't make a document a candidate; they are only looked up for those that others bring in."""
        gain = weight * np.array([self.most[self.blocks[x] : self.blocks[x + 1]].max() for x in lists])
        order = np.argsort(gain, kind="stable")
        pivot = int(np.searchsorted(np.cumsum(gain[order]), needed))
        total = np.zeros(self.size, np.int64)
        for k in order[pivot:]:
            x = lists[k]
            doc = self.doc[self.start[x] : self.start[x + 1]]
            low, high = np.searchsorted(doc, a), np.searchsorted(doc, b)
            n = high - low
            at = np.repeat(low, n) + tx.spread(n)
            total[doc[at]] += weight[k] * self.score[self.start[x] + at]  # a list has a document once
        found = np.flatnonzero(total)
        for k in order[:pivot]:
            x = lists[k]
            doc = self.doc[self.start[x] : self.start[x + 1]]
            at = np.minimum(np.searchsorted(doc, found), len(doc) - 1)
            total[found] += np.where(doc[at] == found, weight[k] * self.score[self.start[x] + at], 0)
        return found, total[found]


class Best:
    """The first results of one query so far."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document has to score at least."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        own = score >= self.least
        score, ids, no_id = np.append(self.score, score[own]), np.append(self.id, ids[own]), np.append(self.no_id, no_id[own])
        order = np.lexsort((ids, no_id, -score))[: self.top]
        self.score, self.id, self.no_id = score[order], ids[order], no_id[order]


def search_shard(shard: Shard, codes: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Adds the shard's results to best; how many documents were scored."""
    lists = np.searchsorted(shard.term, codes)
    has = (lists < len(shard.term)) & (weight > 0)
    has[has] = shard.term[lists[has]] == codes[has]
    lists, weight = lists[has], weight[has]
    if not len(lists):
        return 0
    a, b, bound = shard.stretches(lists, weight)
    order, read, scored, step = np.argsort(-bound), 0, 0, 4
    while read < len(order) and bound[order[read]] >= best.least:
        some = order[read : read + step]
        some = np.sort(some[bound[some] >= best.least])
        found, score = shard.scores(lists, weight, best.least, a[some], b[some])
        scored += len(found)
        best.add(score, shard.ids[found], shard.no_id[found])
        read, step = read + step, 4 * step
    return scored


def searcher(block: Broadcast, weights: Broadcast, docs: int, words: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = block.value.items, weights.value
        best = [Best(top) for _ in items]
        for b in batches:
            for k in range(b.num_rows):
                shard = Shard({name: b.column(name)[k] for name in ("ids", "n", "term", "start", "doc", "tf")}, docs, words)
                for (_, _, codes, counts), own in zip(items, best):
                    search_shard(shard, codes, w[codes] * counts, own)
        sizes = [len(x.score) for x in best]
        join = lambda name, kind: np.concatenate([np.zeros(0, kind), *(getattr(x, name) for x in best)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([x[0] for x in items], np.int64), sizes), pa.int64()),
                pa.array(join("id", np.int64), pa.int64(), mask=join("no_id", bool)),
                pa.array(join("score", np.int64), pa.int64()),
            ],
            names=["number", "doc", "score"],
        )

    return run


def first_of(results: DataFrame, top: int) -> DataFrame:
    """number, rank, doc, score: the first of each query, of rows with its own salt first."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    salted = results.withColumn("salt", F.pmod(F.xxhash64("doc", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= top)


def search(documents: DataFrame, queries: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item, rank, doc_id, score: the top documents of each query."""
    spark, context = documents.sparkSession, documents.sparkSession.sparkContext
    kinds = queries.schema[item].dataType, documents.schema[doc_id].dataType
    out = None
    df = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    for k, block in enumerate(blocks(queries, item, item_text, block_terms)):
        shared = context.broadcast(block)
        index = ws.write(df.mapInArrow(indexer(shared), INDEX), f"index-{k}")
        docs, words = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
        df_of = frequencies(index, len(block.terms))
        weights = context.broadcast(np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df_of], np.int64))
        found = index.drop("docs", "words").mapInArrow(searcher(shared, weights, docs, words, top), "number bigint, doc bigint, score bigint")
        named = spark.createDataFrame([(n, i) for n, i, _, _ in block.items], f"number bigint, item {kinds[0].simpleString()}")  # of one block
        ranked = first_of(found, top).join(named, "number").select(F.col("item").alias(item), "rank", F.col("doc").cast(kinds[1]).alias(doc_id), "score")
        ranked = ws.write(ranked, f"ranked-{k}", top * len(block.items))
        ws.drop(f"index-{k}")
        shared.destroy()
        weights.destroy()
        out = ranked if out is None else out.unionByName(ranked)
    if out is None:
        return queries.filter("false").select(item).crossJoin(documents.filter("false").select(doc_id)).select(item, F.lit(0).alias("rank"), doc_id, F.lit(0).cast("long").alias("score"))
    return out


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark, "op12"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (
  SELECT item_id, t, count(*) AS qf
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark)
  GROUP BY item_id, t),
c AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, n, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS wt FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c),
x AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words)) AS part FROM p, c),
s AS (SELECT item_id, doc_id, CAST(sum(qf * wt * part) AS BIGINT) AS score FROM q JOIN f USING (t) JOIN x USING (t) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
