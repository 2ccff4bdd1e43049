"""Language-model scores by deleted interpolation of word n-grams.

The model mixes the uniform, unigram and bigram maximum-likelihood estimates,

    p(w | u) = l0 / (V + 1) + l1 c(w) / N + l2 c(u w) / c(u),

with weights l that depend on a bucket of the context's frequency c(u). They are learned by expectation-maximisation on
held-out counts: each training token is scored with its own occurrence deleted from all counts (c(w) - 1 of N - 1 and
so on, context bucket included), so every token of the corpus is held-out data once.

Counts are taken and brought back to the documents in packed form (see ``chunks``); the vocabulary and the pairs are
never on the driver nor broadcast. For the weights, tokens are counted by bucket and by the two deleted estimates on a
logarithmic grid, a table whose size the grid bounds; all tokens are in it.

Defined results: null text is empty and is one end token; an end is a word of the model that no text word equals, and
so is the start context; without any training document all counts are 0 and every token gets the uniform part; repeated
rows are documents like others; rows without an id count as held out; other columns aren't read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import chunks as ck
from sigmill.llm import text as tx
from sigmill.llm.workspace import Workspace, table

FOLDS, HELD_OUT = 5, 1
BUCKETS = 40
GRID = 4.0  # cells for each factor of e
ROUNDS = 40
#: About as many cells as occur; only the number of files follows from it. The grid bounds them: buckets x unigram x bigram steps.
CELL_ROWS = 40_000
END = tx.mix(np.array([0xE7D], np.uint64))[0]
START = tx.mix(np.array([0x57A], np.uint64))[0]
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def held_out(ids: pa.ChunkedArray | pa.Array, folds: int = FOLDS, fold: int = HELD_OUT) -> np.ndarray:
    """crc32 of the id as text, mod folds; a null id is held out."""
    return np.fromiter((x is None or zlib.crc32(str(x).encode()) % folds == fold for x in ids.to_pylist()), bool, len(ids))


class Tokens:
    """The tokens of a chunk's documents, ends included, as indices into sorted distinct keys of words and of pairs."""

    def __init__(self, docs: pa.Table):
        w = tx.words(docs["text"], tx.LOWER)
        vocab = np.concatenate([w.hashes(5), [END]]).astype(np.uint64)
        self.at = w.at + np.arange(len(w.at))
        codes = np.insert(w.codes, w.at[1:], len(vocab) - 1)
        before = np.empty_like(codes)
        before[1:] = codes[:-1]
        before[self.at[:-1]] = len(vocab) - 1  # a start is as frequent as an end
        self.train = ~held_out(docs["doc_id"])
        self.training = np.repeat(self.train, np.diff(self.at))
        self.words, place = np.unique(vocab, return_inverse=True)
        self.word, self.context = place.astype(np.int32)[codes], place.astype(np.int32)[before]
        pairs = tx.mix(np.append(vocab[:-1], START) * _PAIR)[before] + vocab[codes]
        del codes, before, w
        order = np.argsort(pairs)
        pairs = pairs[order]
        first = np.concatenate([[True], pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, bool)
        self.pairs = pairs[first]
        self.pair = np.empty(len(pairs), np.int32)
        self.pair[order] = np.cumsum(first, dtype=np.int32) - 1


def ask(docs: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    t = Tokens(docs)
    return [(keys, np.bincount(which[t.training], minlength=len(keys))) for keys, which in ((t.words, t.word), (t.pairs, t.pair))]


@dataclass
class Model:
    """N training tokens, V distinct ones, and the weights (uniform, unigram, bigram) of each context bucket."""

    total: int
    types: int
    weights: np.ndarray

    @staticmethod
    def bucket(context: np.ndarray) -> np.ndarray:
        return np.minimum(np.frexp(np.maximum(context, 0).astype(float))[1].astype(np.int64), BUCKETS - 1)  # 64 bits, since keys of cells are shifted

    def parts(self, word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int) -> list[np.ndarray]:
        return [np.full(len(word), 1 / (self.types + 1)), word / max(total, 1), pair / np.maximum(context, 1)]


def deleted(model: Model):
    """For each chunk, how many training tokens have which bucket and which deleted estimates."""

    def use(docs: pa.Table, totals: list[np.ndarray]) -> pa.Table:
        t = Tokens(docs)
        own = t.training
        c = [totals[0][t.word[own]] - 1, totals[0][t.context[own]] - 1, totals[1][t.pair[own]] - 1]
        _, uni, bi = model.parts(*c, model.total - 1)
        cell = [np.where(p > 0, np.round(-np.log(np.where(p > 0, p, 1)) * GRID), -1).astype(np.int64) for p in (uni, bi)]
        key = (model.bucket(c[1]) << 40) | ((cell[0] + 1) << 20) | (cell[1] + 1)
        keys, n = np.unique(key, return_counts=True)
        return pa.table({"key": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

    return use


def learn(cells: list, model: Model) -> np.ndarray:
    """Weights of each bucket by expectation-maximisation; a bucket without tokens takes those of the next one that has some."""
    key, n = np.array([r[0] for r in cells], np.int64), np.array([r[1] for r in cells], float)
    value = lambda q: np.where(q > 0, np.exp(-(q - 1) / GRID), 0.0)
    p = np.stack([np.full(len(key), 1 / (model.types + 1)), value((key >> 20) & 0xFFFFF), value(key & 0xFFFFF)], 1) if len(key) else np.zeros((0, 3))
    bucket, weights = key >> 40, np.full((BUCKETS, 3), np.nan)
    for b in np.unique(bucket):
        own, m, w = p[bucket == b], n[bucket == b], np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            share = own * w
            share /= share.sum(1, keepdims=True)
            w = (share * m[:, None]).sum(0) / m.sum()
        weights[b] = np.maximum(w, 1e-9) / np.maximum(w, 1e-9).sum()
    seen = np.flatnonzero(~np.isnan(weights[:, 0]))
    for b in range(BUCKETS):
        if np.isnan(weights[b, 0]):
            weights[b] = weights[seen[np.argmin(abs(seen - b))]] if len(seen) else (1.0, 0.0, 0.0)
    return weights


SCHEMA = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scorer(model: Model):
    def use(docs: pa.Table, totals: list[np.ndarray]) -> pa.Table:
        t = Tokens(docs)
        word, context, pair = totals[0][t.word], totals[0][t.context], totals[1][t.pair]
        weights = model.weights[model.bucket(context)]
        p = sum(weights[:, k] * x for k, x in enumerate(model.parts(word, context, pair, model.total)))
        base = np.log10((word + 0.5) / (model.total + 0.5 * (model.types + 1)))
        add = lambda x: np.add.reduceat(x, t.at[:-1])  # noqa: E731  every document has its end token
        return pa.table(
            {
                "doc_id": docs["doc_id"],
                "held_out": pa.array(~t.train),
                "n_tokens": pa.array(np.diff(t.at), pa.int64()),
                "n_known": pa.array(add((word > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(t.train), model.total), pa.int64()),
                "base_score": pa.array(add(base), pa.float64()),
                "score": pa.array(add(np.log10(p)), pa.float64()),
            }
        )

    return use


def score(documents: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and SCHEMA for each document row."""
    kind = documents.schema[doc_id].dataType.simpleString()
    packed = ck.Chunks.of(documents, ws, doc_id, text)
    replies = ws.write(ck.answers(packed, ck.questions(packed, ask), 2), "totals")
    sums = {r["kind"]: r for r in replies.filter("chunk IS NULL").groupBy("kind").agg(F.sum("types").alias("types"), F.sum("total").alias("total")).collect()}
    model = Model(sums[0]["total"], sums[0]["types"], np.zeros((BUCKETS, 3))) if 0 in sums else Model(0, 0, np.zeros((BUCKETS, 3)))
    cells = ck.answered(packed, replies, deleted(model), "key bigint, n bigint", 2).groupBy("key").agg(F.sum("n").alias("n"))
    cells = ws.write(cells, "cells", CELL_ROWS)  # writing lets go of the shuffle files
    model.weights = learn(cells.collect(), model)
    out = ws.write(ck.answered(packed, replies, scorer(model), f"doc_id {kind}, {SCHEMA}", 2), "scores")
    ws.drop("chunks", "totals", "cells")
    return out


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), Workspace(spark, "op2"))


#: DuckDB has no crc32, so the folds, and with them all columns, are out of its reach.
ORACLE_SQL = None
