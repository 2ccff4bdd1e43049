"""Token ids of whole texts, and Parquet files of token ids that can be read in parts.

Encoding a corpus word by word costs more than it must: most words come again. Texts are cut into chunks where no token
can span the cut, each distinct chunk of a batch is encoded once with the tokenizers library, and its ids are put in
every place where it stands. The cuts are before a run of ASCII white space that follows something else, and between a
Latin letter and a stop or comma. Both pre-tokenizers used here never take such a pair into one piece and don't look
back, so the ids are those of the whole text; other white space, which could be ambiguous, isn't cut at. A worker
remembers the ids of a bounded number of chunks.

Defined results: null text is empty and has its end id alone; repeated rows are encoded and written each by itself, rows
of one id ordered by a hash of the text; rows with a null id come first; texts of any length are encoded whole; an empty
table gives an empty token table; other columns aren't read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm import text as tx
from sigmill.llm.workspace import Workspace, table

END_ID = 2
BATCH_BYTES = 3 << 20
#: Of text in a range, each of which is a task and a file.
RANGE_BYTES = 512 << 20
REMEMBERED = 1_000_000

_SPACE = np.isin(np.arange(256), list(tx.SPACES))
_STOP = np.isin(np.arange(256), list(b".,;:!?"))
_LETTER = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B)])
_encoders: dict[str, Encoder] = {}


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or one of at least twice its size that begins with it, if it has no room for size entries."""
    if size <= len(array):
        return array
    out = np.empty(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Encoder:
    """One tokenizer file in one worker, and the ids of the first chunks that it met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.number: dict[str, int] = {}  # of a remembered chunk
        self.start, self.pool = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)  # chunk k has pool[start[k]:start[k + 1]]

    @staticmethod
    def of(path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def fresh(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all their ids."""
        ids = []
        for k in range(0, len(texts), 10_000):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + 10_000], add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))

    def chunks(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each distinct chunk has, and where they start in the pool (until the next call)."""
        texts, known = distinct.to_pylist(), len(self.number)
        number = np.fromiter((self.number.get(t, -1) for t in texts), np.int64, len(texts))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = known + np.arange(len(new))
            size, ids = self.fresh([texts[k] for k in new])
            at = int(self.start[known])
            self.start, self.pool = grown(self.start, known + len(new) + 1), grown(self.pool, at + len(ids))
            self.start[known + 1 : known + len(new) + 1] = at + np.cumsum(size)
            self.pool[at : at + len(ids)] = ids
            for k in new[: max(0, REMEMBERED - known)]:  # what doesn't fit is written over by the next batch
                self.number[texts[k]] = int(number[k])
        return self.start[number + 1] - self.start[number], self.start[number]

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all rows, and where each row starts in them; end is added to every row."""
        column = tx.plain(column)
        data, at = tx.data_of(column)
        cut = cuts(data, at)
        coded = tx.of_data(data, cut).dictionary_encode()
        size, start = self.chunks(coded.dictionary)
        codes = np.asarray(coded.indices)
        n = size[codes]
        before = np.concatenate([[0], np.cumsum(n)])
        row_at = before[np.searchsorted(cut, at)]
        flat = self.pool[np.arange(before[-1]) + np.repeat(start[codes] - before[:-1], n)]
        if end is not None:
            flat = np.insert(flat, row_at[1:], end)
            row_at = row_at + np.arange(len(row_at))
        return flat, row_at


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every row's start and the end, and the places inside rows where no token spans the cut: before white space that
    follows what surely isn't white space, and between a Latin letter and a stop or comma."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 3:
        space = _SPACE[data]
        where = np.flatnonzero(space[3:] & ~space[2:-1]) + 3
        b3, b2, b1 = data[where - 3], data[where - 2], data[where - 1]
        # not after U+0085, U+00A0, U+1680, U+2000-207F, U+3000-303F or U+001C-001F, some of which are white space too
        wide = ((b3 == 0xE1) & (b2 == 0x9A)) | ((b3 == 0xE2) & ((b2 == 0x80) | (b2 == 0x81))) | ((b3 == 0xE3) & (b2 == 0x80))
        cut[where[~(wide | ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((b1 >= 0x1C) & (b1 <= 0x1F)))]] = True
        where = np.flatnonzero(_STOP[data[2:]]) + 2
        b2, b1 = data[where - 2], data[where - 1]
        cut[where[_LETTER[b1] | ((b2 == 0xC3) & (b1 >= 0x80) & (b1 != 0x97) & (b1 != 0xB7))]] = True
    cut[at] = True
    return np.flatnonzero(cut)


def crcs(flat: np.ndarray, at: np.ndarray) -> list[int]:
    raw = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
    return [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def path_of(name: str, folder: str | None = None) -> str:
    """A tokenizer file's place: in the folder, or where the installed vocabulary files are."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- token files ----

#: Row groups small enough to skip by doc_id, pages small enough to read a few documents; ids stay dictionary-coded (or
#: delta-coded in the version 2 pages once a dictionary grows too large), and the page index is written with the footer.
FILE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "PARQUET_2_0",
}


def write(documents: DataFrame, ws: Workspace, name: str = "tokens", tokenizer: str | None = None, end: int | None = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes token files in ascending doc_id order and returns them as a table: part (number of the file's range),
    place (of the document in its part), doc_id, n_tokens, ids.

    Texts move once, to ranges of doc_id (of about RANGE_BYTES of text at most, by a sample of ids); equal ids are ordered by text, rows without an id come first. Reading
    only doc_id and n_tokens doesn't touch the ids; a filter on doc_id reads the row groups and pages that may hold it.
    """
    tokenizer = tokenizer or path_of("byte_bpe_50k.json")
    spark = documents.sparkSession
    df = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    size = df.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ranged = df.repartitionByRange(ranges, "doc_id", F.xxhash64("_text")).sortWithinPartitions("doc_id", F.xxhash64("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for b in tx.slices(batches, "_text", BATCH_BYTES):
            flat, at = Encoder.of(tokenizer).encode(b.column("_text"), end)
            n = b.num_rows
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(place, place + n), pa.int64()), b.column("doc_id"), pa.array(np.diff(at), pa.int64()), ids],
                names=["part", "place", "doc_id", "n_tokens", "ids"],
            )
            place += n

    out = ranged.mapInArrow(run, f"part int, place bigint, doc_id {kind}, n_tokens bigint, ids array<int>")
    return ws.write(out, name, **FILE_OPTIONS)


def report(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, all from the token files."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            at = np.asarray(ids.offsets).astype(np.int64)
            flat = np.asarray(ids.values.slice(at[0], at[-1] - at[0])) if len(ids) else np.zeros(0)
            n = pa.array(np.diff(at), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("place"), b.column("doc_id"), n, pa.array(crcs(flat, at - at[0]), pa.int64())], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    read = tokens.select("part", "place", "doc_id", "ids").mapInArrow(run, f"part int, place bigint, doc_id {kind}, n_tokens bigint, ids_crc32 bigint")
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_before"))
    own = Window.partitionBy("part").orderBy("place")
    return read.join(before, "part").select("doc_id", (F.col("_before") + F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(write(table(spark, sf_dir, "documents"), Workspace(spark, "op5")))
