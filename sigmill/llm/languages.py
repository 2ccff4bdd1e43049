"""Language identification with bit-sliced Bloom filters of character n-grams.

Slot i of the filter holds one bit for each language; an n-gram's languages are the AND of its slots' words, so one look-up
gives all languages that contain it. A text's n-grams are counted by language, each count is corrected for the
language's rate of false positives, and the largest wins.

An n-gram belongs to a language if its rate there reaches ``FLOOR`` and a share of its highest rate in any language; so
foreign passages in a language's texts don't fill its filter; one that was seen once tells nothing of a rate and is left out.
Every such n-gram is in the filter; since rates add up to 1,
a language has at most 1 / FLOOR of them, and the number of slots follows from how many there are. Filters are fitted on
about ``TRAIN_DOCS`` labelled documents of each language, chosen by hash, which is the bound of what they learn from; the
prediction reads whole texts and nothing but them.

Defined results: null text, or text without a letter, is ``und`` with score 0; a text without a known n-gram gets the
most frequent language of the training documents with score 0 (``und`` if there are none); ties go to the first
language by name; repeated rows are judged each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.llm import text as tx

SIZES = (3, 4)
TRAIN_DOCS = 4_000
FLOOR, SHARE = 2e-6, 0.3
HASHES, SLOTS_PER_GRAM = 2, 8
FOLDS, HELD_OUT = 4, 2
BATCH_BYTES = 1 << 20
UND = "und"



@cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all rows, a space at both ends of each and in place of all but letters; row starts."""
    column = pc.utf8_lower(column)
    sizes = np.asarray(pc.utf8_length(column)).astype(np.int64) + 2
    padded = pc.binary_join_element_wise(" ", column, " ", "")
    data, _ = tx.data_of(tx.plain(padded))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return np.where(letters()[points], points, 0x20).astype(np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def grams(points: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams with at most one space, and where each starts; none crosses a row's end."""
    space = np.concatenate([[0], np.cumsum(points == 0x20)])
    count = len(points) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ok = space[n:] - space[:count] <= 1
    for row_end in range(1, n):  # starts so near a row's end would take in the next row's space too
        ends = at[1:-1] - row_end
        ok[ends[(ends >= 0) & (ends < count)]] = False
    where = np.flatnonzero(ok)
    return tx.windows(points, n, seed=n)[where], where


@dataclass
class Filters:
    """words[j][i]: slot i for languages 64 j and on; false: the rate of false positives by language."""

    languages: list[str]
    words: list[np.ndarray]
    false: np.ndarray
    usual: str

    bits: int = 10

    def slots(self, keys: np.ndarray) -> list[np.ndarray]:
        return [((keys >> np.uint64(k * (64 // HASHES))) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for k in range(HASHES)]

    @staticmethod
    def of(members: dict[str, np.ndarray], usual: str) -> Filters:
        names = sorted(members)
        out = Filters(names, [], np.zeros(0), usual, max(10, (SLOTS_PER_GRAM * max(map(len, members.values()), default=0)).bit_length()))
        out.words = words = [np.zeros(1 << out.bits, np.uint64) for _ in range(-(-len(names) // 64))]
        for k, name in enumerate(names):
            for slot in out.slots(members[name]):
                words[k // 64][slot] |= np.uint64(1) << np.uint64(k % 64)
        filled = [((words[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(names))]
        out.false = np.array(filled) ** HASHES
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        column = tx.plain(column)
        points, at = codes(column)
        rows, size = len(column), len(self.languages)
        hits, total = np.zeros((rows, max(size, 1))), np.zeros(rows)
        for n in SIZES if size else ():
            keys, where = grams(points, at, n)
            cut = np.searchsorted(where, at)
            total += np.diff(cut)
            slots = self.slots(keys)
            for j, table in enumerate(self.words):
                mask = table[slots[0]]
                for s in slots[1:]:
                    mask &= table[s]
                for k in range(64 * j, min(size, 64 * j + 64)):
                    hits[:, k] += tx.sums(((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64), cut)
        if size:
            hits = np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false))
        best, every = np.argmax(hits, 1), hits.sum(1)
        letter = np.asarray(pc.match_substring_regex(column, r"\p{L}"))
        score = np.where(letter & (every > 0), hits[np.arange(rows), best] / np.where(every > 0, every, 1), 0.0)
        names = [UND if not a else self.languages[b] if e > 0 else self.usual for a, b, e in zip(letter, best, every)]
        return names, score


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filters:
    """Filters from rows with a text and a language."""
    df = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("_text"), F.col(lang).alias("lang"), F.xxhash64(F.col(key)).alias("_key"))
    seen = {r["lang"]: r["count"] for r in df.groupBy("lang").count().collect()}
    if not seen:
        return Filters([], [], np.zeros(0), UND)
    rates = F.from_json(F.lit(json.dumps({name: min(1.0, TRAIN_DOCS / n) for name, n in seen.items()})), "map<string,double>")
    some = df.filter(F.pmod("_key", F.lit(1 << 30)) < rates[F.col("lang")] * float(1 << 30)).select("lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "_text", BATCH_BYTES):
            for name in pc.unique(b.column("lang")).to_pylist():
                points, at = codes(tx.plain(b.filter(pc.equal(b.column("lang"), name)).column("_text")))
                keys, n = np.unique(np.concatenate([grams(points, at, k)[0] for k in SIZES]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counts = some.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rates = counts.join(total, "lang").withColumn("rate", F.col("n") / F.col("total")).filter((F.col("rate") >= FLOOR) & (F.col("n") > 1))
    own = rates.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= SHARE * F.col("top"))
    members = {name: [] for name in seen}
    for r in own.select("lang", "gram").toLocalIterator():  # 1 / FLOOR for each language at most
        members[r["lang"]].append(r["gram"])
    return Filters.of({k: np.array(v, np.int64).view(np.uint64) for k, v in members.items()}, min(seen, key=lambda k: (-seen[k], k)))


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def identify(documents: DataFrame, filters: Filters, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document row."""
    df = documents.select(F.col(doc_id).alias("doc_id"), fold(doc_id).alias("held_out"), F.col(text).alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(filters)  # a few slots' words for each of the languages, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "_text", BATCH_BYTES):
            names, score = shared.value.predict(b.column("_text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep(documents: DataFrame, filters: Filters, wanted: list[str] | None = None, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows whose language is found with some certainty (and is a wanted one), with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, text, BATCH_BYTES):
            found, score = shared.value.predict(b.column(text))
            yield b.filter(pa.array([x != UND and s >= least and (wanted is None or x in wanted) for x, s in zip(found, score)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigmill.llm.workspace import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.filter(~fold())))
