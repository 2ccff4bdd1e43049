"""Benchmark decontamination with a Wu-Manber search over words.

The alphabet is words. Each benchmark item gives windows of ``width`` consecutive words (one shorter window if the item
has fewer). Windows of one length make a pattern set with the three tables of the method:

* SHIFT, indexed by a hash of the last two words of the text window: how far the search may move on, because no pattern
  has that pair nearer to its end;
* HASH, indexed by the same hash of a suffix block: the bucket of the patterns that end in it, for positions with shift 0;
  within a bucket patterns are sorted by PREFIX, the hash of their first two words, which selects the test patterns;
* the patterns themselves, compared word by word, which confirms each occurrence.

Texts are cut into lanes that all move through their own stretch at once, so each step is one numpy gather for many
positions. One block of at most about ``block_windows`` windows is on the driver and sent to the executors at a time (a
longer item is cut into blocks whose windows overlap). A benchmark of one block takes one pass without a shuffle. A larger
one takes a pass for each block, and each pass is written before the next block is read: the hits of a document (never
its text) then meet by its row number.

Defined results: null or empty text has no words and no hits; an item without words matches nothing; equal windows of
several items count for each of them; repeated rows are judged one by one; an empty benchmark hits nothing. Benchmark
rows with a null id have windows like all others, so they count in n_hit and contaminated; all of them together are one
item in n_items, and items_sha256, which is over the ids, leaves them out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import text as tx
from sigmill.llm.workspace import Workspace, table

WIDTH = 10
BLOCK_WINDOWS = 250_000
BATCH_BYTES = 4 << 20
LANE = 256
SHIFT_BITS = 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 0x20 for c in range(0x41, 0x5B)}
_SPANS = "array<struct<a:bigint,b:bigint>>"


class PatternSet:
    """Wu-Manber tables for patterns of one length, as rows of word numbers."""

    def __init__(self, patterns: np.ndarray, owners: list[np.ndarray]):
        self.m = patterns.shape[1]
        self.block = min(2, self.m)
        suffix, prefix = self._slot(patterns[:, self.m - self.block :]), self._slot(patterns[:, : self.block])
        order = np.lexsort((prefix, suffix))
        self.patterns, self.owners = patterns[order], [owners[i] for i in order]
        self.bucket = np.searchsorted(suffix[order], np.arange((1 << SHIFT_BITS) + 1)).astype(np.int32)
        self.prefix = (suffix[order] << SHIFT_BITS) | prefix[order]  # in order within a bucket, and so over all
        self.shift = np.full(1 << SHIFT_BITS, self.m - self.block + 1, np.uint8 if self.m < 255 else np.int64)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self._slot(patterns[:, end - self.block : end]), self.m - end)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        x = pairs[:, 0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if pairs.shape[1] > 1:
            x = x + pairs[:, 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (tx.mix(x) >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)

    def _blocks(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._slot(np.stack([codes[ends - 1], codes[ends]], 1) if self.block == 2 else codes[ends][:, None])

    def find(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start positions in codes and numbers of the patterns that occur there; none crosses a row's end."""
        m, none = self.m, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        if len(codes) < m:
            return none
        first, last = at[:-1] + m - 1, at[1:]  # ends of windows lie in [first, last)
        pieces = np.maximum(0, -((first - last) // LANE))
        pos = np.repeat(first, pieces) + tx.spread(pieces) * LANE
        stop = np.minimum(pos + LANE, np.repeat(last, pieces))
        ends, slots = [], []
        while len(pos):
            slot = self._blocks(codes, pos)
            step = self.shift[slot]
            ends.append(pos[step == 0])
            slots.append(slot[step == 0])
            pos = pos + np.maximum(step, 1)
            on = pos < stop
            pos, stop = pos[on], stop[on]
        starts, slot = np.concatenate(ends) - (m - 1), np.concatenate(slots)
        full = self.bucket[slot + 1] > self.bucket[slot]
        starts, slot = starts[full], slot[full]
        if not len(starts):
            return none
        key = (slot << SHIFT_BITS) | self._blocks(codes, starts + self.block - 1)
        low, high = np.searchsorted(self.prefix, key, "left"), np.searchsorted(self.prefix, key, "right")
        n = high - low
        starts, which = np.repeat(starts, n), np.repeat(low, n) + tx.spread(n)
        same = np.ones(len(starts), bool)
        for k in range(m):
            same &= codes[starts + k] == self.patterns[which, k]
        return starts[same], which[same]


class Index:
    """The pattern sets of one block of benchmark items, with their own word numbers."""

    def __init__(self, items: list[str | None], texts: list[str], width: int):
        self.items = items
        w = tx.words(pa.array(texts, pa.string()), tx.ALNUM)
        self.vocab = w.vocab
        by_length: dict[int, dict[bytes, set[int]]] = {}
        for i in range(len(items)):
            own = w.codes[w.at[i] : w.at[i + 1]]
            m = min(width, len(own))
            for k in range(len(own) - m + 1 if m else 0):
                by_length.setdefault(m, {}).setdefault(own[k : k + m].tobytes(), set()).add(i)
        self.sets = [
            PatternSet(np.frombuffer(b"".join(found), np.int64).reshape(-1, m), [np.array(sorted(x)) for x in found.values()])
            for m, found in sorted(by_length.items())
        ]

    def scan(self, w: tx.Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, PatternSet]]]:
        """Which words are hit; and for each pattern set the starts and patterns found."""
        known = pa.compute.index_in(w.vocab, self.vocab).fill_null(-1)
        codes = np.asarray(known).astype(np.int64)[w.codes] if len(w.codes) else w.codes
        found, edge = [], np.zeros(len(codes) + 1, np.int64)
        for s in self.sets:
            starts, which = s.find(codes, w.at)
            found.append((starts, which, s))
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + s.m, -1)
        return np.cumsum(edge[:-1]) > 0, found


def _scanner(index: Broadcast):
    """_row, _doc_id, _n_words, the spans of hit words and the items of the block that occur, for each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "_text", BATCH_BYTES):
            w = tx.words(b.column("_text"), tx.ALNUM)
            hit, found = index.value.scan(w)
            spans, items = [[] for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]
            change = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            a, z = change[::2], change[1::2]
            rows = np.searchsorted(w.at, a, "right") - 1
            for r, x, y in zip(rows, a, z):  # a run that goes on into later rows is cut at each row's end
                while x < y:
                    to = min(y, w.at[r + 1])
                    if to > x:
                        spans[r].append({"a": int(x - w.at[r]), "b": int(to - w.at[r])})
                    x, r = to, r + 1
            for starts, which, s in found:
                for r, p in set(zip((np.searchsorted(w.at, starts, "right") - 1).tolist(), which.tolist())):
                    items[r].update(index.value.items[i] for i in s.owners[p])
            ordered = [sorted(x, key=lambda i: (i is not None, i)) for x in items]
            yield pa.RecordBatch.from_arrays(
                [b.column("_row"), b.column("_doc_id"), pa.array(w.n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(ordered, pa.list_(pa.string()))],
                names=["_row", "_doc_id", "_n_words", "_spans", "_items"],
            )

    return scan


def _pieces(text: str, width: int, most: int) -> Iterator[str]:
    """The text, or parts of it that hold all its windows, of at most most windows each."""
    if len(text) // 2 + 1 <= most:  # no more words than that
        yield text
        return
    words = _WORD.findall(text.translate(_LOWER))
    for k in range(0, max(1, len(words) - width + 1), most):
        yield " ".join(words[k : k + most + width - 1])


def blocks(benchmark: DataFrame, item: str, text: str, most: int, width: int = WIDTH) -> Iterator[Index]:
    """Indexes of the items that have a text, null ids too, in blocks of about ``most`` windows; an index is made when it
    is asked for, and only what belongs to its block is on the driver."""
    items, texts, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("string"), text).filter(F.col(text).isNotNull()).toLocalIterator():
        for piece in _pieces(row[1], width, most):
            items.append(row[0])
            texts.append(piece)
            size += len(piece) // 2 + 1
            if size >= most:
                yield Index(items, texts, width)
                items, texts, size = [], [], 0
    if items:
        yield Index(items, texts, width)


def find(documents: DataFrame, benchmark: DataFrame, ws: Workspace | None = None, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per document row: its id, n_words, the spans of hit words [a, b) and the items that occur, as strings, sorted, a null id first."""
    context = documents.sparkSession.sparkContext
    named = [F.col("_doc_id").alias(doc_id), F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("items")]
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"_row bigint, _doc_id {kind}, _n_words bigint, _spans {_SPANS}, _items array<string>"
    df = documents.select(F.lit(0).cast("long").alias("_row"), F.col(doc_id).alias("_doc_id"), F.col(text).alias("_text"))
    each = blocks(benchmark, item, item_text, block_windows, width)
    first, second = next(each, None) or Index([], [], width), next(each, None)
    if second is None:
        return df.mapInArrow(_scanner(context.broadcast(first)), schema).select(*named)

    ws = ws or Workspace(documents.sparkSession, "decontaminate")
    rows = ws.write(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    hits = None
    for k, index in enumerate(chain([first, second], each)):
        first = second = None
        shared = context.broadcast(index)
        found = rows.mapInArrow(_scanner(shared), schema)
        found = ws.write(found if hits is None else found.filter(F.size("_spans") > 0), f"hits-{k}")
        hits = found if hits is None else hits.unionByName(found)
        shared.destroy()
    ws.drop("rows")
    lists = hits.groupBy("_row").agg(  # a row for each block that hits a document, so as many as there are blocks at most
        F.first("_doc_id", True).alias("_doc_id"), F.first("_n_words").alias("_n_words"), F.flatten(F.collect_list("_spans")).alias("_spans"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items")
    )
    return lists.withColumn("_items", F.sort_array("_items")).select(*named)


def merged_length(spans: str) -> F.Column:
    """Words in the union of spans that may overlap, as several blocks may hit the same words."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["b"] - F.greatest(x["a"], s["to"]), F.lit(0))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")),
        lambda s: s["n"],
    )


def report(documents: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each document row."""
    found = find(documents, benchmark, **names)
    return found.select(
        found.columns[0],
        "n_words",
        merged_length("spans").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(documents: DataFrame, benchmark: DataFrame, ws: Workspace | None = None, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns. With several blocks, what each pass keeps
    is written before the next block is read."""
    context = documents.sparkSession.sparkContext

    def keeper(index: Broadcast):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in tx.slices(batches, text, BATCH_BYTES):
                w = tx.words(b.column(text), tx.ALNUM)
                hit, _ = index.value.scan(w)
                yield b.filter(pa.array(tx.sums(hit.astype(np.int64), w.at) == 0))

        return keep

    each = blocks(benchmark, item, item_text, block_windows, width)
    index, df = next(each, None), documents
    k = 0
    while index is not None:
        shared, index = context.broadcast(index), None
        df = df.mapInArrow(keeper(shared), documents.schema)
        if (index := next(each, None)) is not None:
            ws = ws or Workspace(documents.sparkSession, "clean")
            df = ws.write(df, f"kept-{k}")
            shared.destroy()
            if k:
                ws.drop(f"kept-{k - 1}")
            k += 1
    return df


#: DuckDB. Windows are compared as space-joined words, which hold no space themselves.
ORACLE_SQL = r"""
WITH doc_words AS (
  SELECT rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rn, doc_id, text FROM documents)),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM item_words WHERE len(w) > 0)),
lens AS (SELECT DISTINCT m FROM pats),
wins AS (
  SELECT rn, m, k, array_to_string(w[k:k + m - 1], ' ') AS p
  FROM (SELECT rn, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM doc_words, lens WHERE len(w) >= m)),
hits AS (SELECT rn, wins.m AS m, k, item_id FROM wins JOIN pats ON wins.m = pats.m AND wins.p = pats.p),
hit_words AS (SELECT rn, count(DISTINCT i) AS n_hit FROM (SELECT rn, unnest(range(k, k + m)) AS i FROM hits) GROUP BY rn),
hit_items AS (SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rn, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY rn)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit_words USING (rn) LEFT JOIN hit_items USING (rn)
"""
