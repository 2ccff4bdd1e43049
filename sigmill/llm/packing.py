"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

A sequence is filled greedily: the largest unpacked piece that fits, again and again, until none fits. Then its smallest
piece is taken out if two unpacked pieces together fill the widened gap more tightly, and they go in instead; this is
repeated while it helps. Pieces of one length are alike, so a count for each length is all the state there is.

Pieces are dealt at random into groups of about ``group_pieces``, which are packed apart: each group ends with at most
one half-filled sequence, so the sequences lost by the split are at most the number of groups, and no group grows with
the input. Only lengths and ids move in the shuffle, never texts or tokens.

Defined results: null text is empty and packs as its end id alone; repeated rows, and ties of length, each get a place
of their own; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import text as tx
from sigmill.llm import tokens as tk
from sigmill.llm.workspace import Workspace, table

LENGTH = 4096
END_ID = 1
GROUP_PIECES = 40_000


class Pool:
    """Unpacked pieces as counts by length, with the lengths that are left."""

    def __init__(self, lengths: np.ndarray, most: int):
        self.count = np.bincount(lengths, minlength=most + 1)
        self.left = np.flatnonzero(self.count)

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            self.left = np.delete(self.left, np.searchsorted(self.left, length))

    def put(self, length: int) -> None:
        if not self.count[length]:
            self.left = np.insert(self.left, np.searchsorted(self.left, length), length)
        self.count[length] += 1

    def largest(self, gap: int) -> int:
        """The largest length that fits, or 0."""
        k = np.searchsorted(self.left, gap, "right")
        return int(self.left[k - 1]) if k else 0

    def two(self, gap: int) -> tuple[int, int]:
        """Two unpacked pieces whose sum is the largest that fits; (0, 0) if none."""
        first = self.left[: np.searchsorted(self.left, gap)]
        if not len(first):
            return 0, 0
        k = np.searchsorted(self.left, gap - first, "right") - 1
        second = np.where(k >= 0, self.left[np.maximum(k, 0)], 0)
        alone = (second == first) & (self.count[first] < 2)  # the only piece of its length: take the next smaller one
        k = np.where(alone, k - 1, k)
        second = np.where(k >= 0, self.left[np.maximum(k, 0)], 0)
        total = np.where(second > 0, first + second, 0)
        best = int(np.argmax(total))
        return (int(first[best]), int(second[best])) if total[best] else (0, 0)


def fill(lengths: np.ndarray, most: int = LENGTH) -> list[list[int]]:
    """The lengths of the pieces in each sequence."""
    pool, out = Pool(lengths, most), []
    while len(pool.left):
        own, gap = [], most
        while gap and (x := pool.largest(gap)):
            own.append(x)
            pool.take(x)
            gap -= x
        while gap and len(pool.left):
            small = min(own)
            a, b = pool.two(gap + small)
            if a + b <= small:
                break
            own.remove(small)
            own += [a, b]
            pool.take(a)
            pool.take(b)
            pool.put(small)
            gap += small - a - b
        out.append(own)
    return out


def place(lengths: np.ndarray, most: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The number of the sequence, and the offset in it, for each piece."""
    by_length = np.argsort(lengths, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(lengths, minlength=most + 1))])[:-1]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, own in enumerate(fill(lengths, most)):
        used = 0
        for x in own:
            i = by_length[at[x]]
            at[x] += 1
            sequence[i], offset[i] = k, used
            used += x
    return sequence, offset


def pieces(documents: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and a number of its own, row, for each piece."""
    tokenizer = tokenizer or tk.path_of("word_bpe_49k.json")
    df = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for b in tx.slices(batches, "_text", tk.BATCH_BYTES):
            flat, at = tk.Encoder.of(tokenizer).encode(b.column("_text"), end)
            size = np.diff(at)
            n = -(-size // length)
            k = tx.spread(n)
            owner = np.repeat(np.arange(len(n)), n)
            cut = np.append(at[owner] + k * length, at[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(owner)), pa.array(k, pa.int32()), pa.array(k * length, pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array(tk.crcs(flat, cut), pa.int64()), pa.array(np.arange(row, row + len(k)), pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
            )
            row += len(k)

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint")


def pack(documents: DataFrame, ws: Workspace, tokenizer: str | None = None, length: int = LENGTH, end: int = END_ID, group_pieces: int = GROUP_PIECES, **names) -> DataFrame:
    """The pieces with sequence_id and offset."""
    cut = ws.write(pieces(documents, tokenizer, length, end, **names), "pieces")
    groups = max(1, ceil(cut.count() / group_pieces))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("row").combine_chunks()
        sequence, offset = place(np.asarray(t["length"]), length)
        first = t["_group"][0].as_py() << 32
        return t.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(first + sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("_group").applyInArrow(run, f"doc_id {cut.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Workspace(spark, "op7"))
