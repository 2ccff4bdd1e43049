"""Counts of keys over a whole corpus, brought back to where the keys came from, in packed form.

A corpus has about as many shingles or word pairs as words. As a row each they would cost several times the input to
shuffle and sort. Here documents are packed into chunks of a bounded size (one row each, compressed); each chunk asks
for its distinct 64-bit keys in one sorted array for each part of the key range; each part sums what all chunks ask for
and answers each with totals in the order of its question. A chunk and its answers then meet by the chunk's number.

Nothing is collected: a chunk is bounded by ``CHUNK_BYTES`` of text (a longer text is a chunk of its own); the key range
is cut into as many parts as ``PART_BYTES`` of questions each need, from the size of the packed text, so a part doesn't
grow with the corpus; a key that every document holds is one entry for each chunk. A chunk finds its parts by walking over
its own keys, never over all parts, and asks only parts that hold keys of it: work and rows follow the keys, and are never
more than one short row for each key, however many parts there are. A task takes one part, or, from ``MOST_TASKS`` parts
on, several parts one after the other; chunks go ``CHUNKS_PER_TASK`` to a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.llm import text as tx
from sigmill.llm.workspace import Workspace

CHUNK_BYTES = 4 << 20
#: Of packed questions in a part. A byte of text asks for about ASKED bytes of packed keys of one kind.
PART_BYTES, ASKED = 16 << 20, 1.2
CHUNKS_PER_TASK = 2
MOST_TASKS = 20_000

#: Sorted distinct keys and a value of each: what it counts for, or what the least is sought of.
Asked = tuple[np.ndarray, np.ndarray]
#: A chunk's documents to what it asks, for each kind of key.
Asker = Callable[[pa.Table], list[Asked]]


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type without "not null" in the fields of structs, as declared result types have them."""
    return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind]) if pa.types.is_struct(kind) else kind


@dataclass
class Chunks:
    """The written table of chunks (chunk, size, body), the number of tasks for them, and how many leading bits of a key
    tell its part."""

    table: DataFrame
    tasks: int
    bits: int

    @staticmethod
    def of(documents: DataFrame, ws: Workspace, doc_id: str, text: str) -> Chunks:
        table = ws.write(packed(documents, doc_id, text), "chunks", compression="none")
        n, size = table.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        usual = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return Chunks(table, max(1, min(usual, n), -(-n // CHUNKS_PER_TASK)), int(size * ASKED / PART_BYTES).bit_length())


def packed(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """chunk, size, body: the documents' (doc_id, text) in compressed Arrow form, and their size before. Chunk numbers hold
    for one evaluation, so the result has to be written before it is used twice."""
    df = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in held:
                    out.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "size", "body"])

        for b in tx.slices(batches, "text", CHUNK_BYTES // 4):
            if held and size + b.nbytes > CHUNK_BYTES:
                yield row()
                number, held, size = number + 1, [], 0
            held.append(pa.RecordBatch.from_arrays([pa.concat_arrays([c]).cast(nullable(c.type)) for c in b.columns], names=b.schema.names))
            size += b.nbytes
        if held:
            yield row()

    return df.mapInArrow(run, "chunk bigint, size bigint, body binary")


def unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(body).read_all()


def parts_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that sorted keys lie in, and where each begins in them, with the end."""
    part = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return part[first].astype(np.int64), np.append(first, len(keys))


def narrow(values: np.ndarray) -> bytes:
    """Integers as the least of them and their distances from it, each in as few bytes as the largest takes."""
    least = int(values.min()) if len(values) else 0
    off = (values.astype(np.int64) - np.int64(least)).view(np.uint64)
    size = next(w for w in (1, 2, 4, 8) if not len(off) or int(off.max()) < 1 << 8 * w)
    return bytes([size]) + least.to_bytes(8, "little", signed=True) + off.astype(f"<u{size}").tobytes()


def wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.int64) + np.int64(int.from_bytes(raw[1:9], "little", signed=True))


def squeezed(keys: np.ndarray) -> bytes:
    """Sorted distinct keys as the first and the steps from each to the next, each in as few bytes as the largest takes."""
    steps = np.diff(keys, prepend=np.uint64(0))
    first, steps = steps[:1], steps[1:]
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + first.tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def expanded(raw: bytes) -> np.ndarray:
    width = raw[0]
    steps = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[0], out[1:, :width] = np.frombuffer(raw[1:9], np.uint8), steps
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


QUESTIONS = "kind int, part bigint, chunk bigint, keys binary, vals binary"


def rows_of(chunk: int, asked: list[Asked], bits: int) -> pa.Table:
    """A chunk's questions as rows: one for each kind and part that holds keys of it."""
    kind, part, keys, vals = [], [], [], []
    for k, (own, values) in enumerate(asked):
        parts, cut = parts_of(own, bits)
        kind += [k] * len(parts)
        part += parts.tolist()
        keys += [squeezed(own[a:b]) for a, b in zip(cut, cut[1:])]
        vals += [narrow(values[a:b]) for a, b in zip(cut, cut[1:])]
    return pa.table({"kind": pa.array(kind, pa.int32()), "part": pa.array(part, pa.int64()), "chunk": pa.array([chunk] * len(part), pa.int64()), "keys": pa.array(keys, pa.binary()), "vals": pa.array(vals, pa.binary())})


def questions(chunks: Chunks, ask: Asker) -> DataFrame:
    """What every chunk asks."""
    bits = chunks.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, body in zip(b.column("chunk").to_pylist(), b.column("body")):
                yield from rows_of(chunk, ask(unpacked(body.as_py())), bits).to_batches()

    return chunks.table.mapInArrow(run, QUESTIONS)


def answers(chunks: Chunks, asked: DataFrame, kinds: int = 1, least: bool = False) -> DataFrame:
    """chunk, kind, part, totals (packed) for each question: the sums of the values of each key over all chunks, or the
    least of them; and a row without a chunk for each kind and part, with the number of keys that count for something
    (types) and their sum (total)."""
    bits = chunks.bits

    def totals(t: pa.Table) -> pa.Table:
        t = t.sort_by("chunk")
        keys = [expanded(x.as_py()) for x in t["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every)
        every = every[order]
        first = np.concatenate([[True], every[1:] != every[:-1]])
        values = np.concatenate([wide(x.as_py()) for x in t["vals"]])[order]
        sums = (np.minimum if least else np.add).reduceat(values, np.flatnonzero(first))
        back = np.empty(len(every), np.int64)
        back[order] = sums[np.cumsum(first) - 1]
        out = [narrow(x) for x in np.split(back, ends[:-1])]
        n, same = len(out), lambda name: pa.array([t[name][0].as_py()] * (len(out) + 1), t.schema.field(name).type)
        return pa.table(
            {
                "chunk": pa.array([*t["chunk"].to_pylist(), None], pa.int64()),
                "kind": same("kind"),
                "part": same("part"),
                "totals": pa.array([*out, None], pa.binary()),
                "types": pa.array([None] * n + [int((sums > 0).sum())], pa.int64()),
                "total": pa.array([None] * n + [0 if least else int(sums.sum())], pa.int64()),
            }
        )

    tasks = min(kinds << bits, MOST_TASKS)
    dealt = asked.withColumn("slot", F.pmod(F.col("kind") * F.lit(1 << bits) + F.col("part"), F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("slot"))
    # slot is a key too, since then the rows need no second exchange
    return dealt.groupBy("slot", "kind", "part").applyInArrow(totals, "chunk bigint, kind int, part bigint, totals binary, types bigint, total bigint")


def _met(chunks: Chunks, replies: DataFrame, use: Callable[[int, pa.Table, list[np.ndarray]], pa.Table], schema: str, kinds: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("kind", "ascending"), ("part", "ascending")])
        kind = np.asarray(right["kind"])
        raw = right["totals"].to_pylist()
        totals = [np.concatenate([np.zeros(0, np.int64), *(wide(x) for x, k in zip(raw, kind) if k == want)]) for want in range(kinds)]
        return pa.concat_tables(use(chunk, unpacked(body.as_py()), totals) for chunk, body in zip(left["chunk"].to_pylist(), left["body"]))

    own = replies.filter(F.col("chunk").isNotNull()).select("chunk", "kind", "part", "totals").repartition(chunks.tasks, "chunk")
    bodies = chunks.table.select("chunk", "body").repartition(chunks.tasks, "chunk")
    return bodies.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(run, schema)


def answered(chunks: Chunks, replies: DataFrame, use: Callable[[pa.Table, list[np.ndarray]], pa.Table], schema: str, kinds: int = 1) -> DataFrame:
    """use(documents, totals for each kind in the order of the keys) for each chunk."""
    return _met(chunks, replies, lambda _, docs, totals: use(docs, totals), schema, kinds)


def asked_on(chunks: Chunks, replies: DataFrame, ask: Callable[[pa.Table, list[np.ndarray]], list[Asked]], kinds: int = 1) -> DataFrame:
    """What every chunk asks next, from the answers so far."""
    bits = chunks.bits
    return _met(chunks, replies, lambda chunk, docs, totals: rows_of(chunk, ask(docs, totals), bits), QUESTIONS, kinds)
