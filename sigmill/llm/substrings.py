"""Removal of passages that occur before, by level-wise doubling.

A window is ``width`` consecutive words of one document; each word that lies in a window whose words also start earlier
(in a document of smaller id, or earlier in the same one) goes. Lengths double from ``seed`` words up to the width:

* at a length w below the width, a window is stood for by one of its own runs of w words, that with the smallest hash;
  equal windows have equal ones, so a window whose run occurs once in the corpus is alone and goes no further;
* only windows whose run is repeated at length w are asked for at length 2 w, in the same way;
* at the width the run is the window itself, and the smallest document that has it is sought. Longer lengths would change
  nothing in what is removed, so the levels end there, or as soon as no candidate survives one.

Neighbouring windows mostly share their smallest run, so a short length asks for one run in about (width - w) / 2 words,
and the full length only for windows that are repeated so far. Runs are compared by 64-bit hashes, others at each length:
two windows would have to agree in them at every level to be mistaken for each other.

Hashes move packed (see ``chunks``): each chunk of documents asks for its distinct ones, by parts of their range, and is
answered in their order. A passage that every document holds is one question for each chunk, and no list of its places is
ever made. Nothing is collected.

Defined results: null or empty text has no words and nothing to remove; a text of fewer words than the width neither; of
repeated rows of one id, none is earlier than the other, and a row without an id comes after all that have one (nor are
two of these earlier than each other); within one row an earlier start always counts; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import chunks as ck
from sigmill.llm import text as tx
from sigmill.llm.workspace import Workspace, table

WIDTH = 20
SEED = 5
NO_ID = np.iinfo(np.int64).max


def lengths(width: int, seed: int) -> list[int]:
    """seed, 2 seed, .. below the width, and the width."""
    out = [min(seed, width)]
    while out[-1] < width:
        out.append(min(2 * out[-1], width))
    return out


def sliding(values: np.ndarray, k: int, best: np.ufunc) -> np.ndarray:
    """The best of each k consecutive values."""
    size = 1
    while 2 * size <= k:
        values = best(values[:-size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    return best(values[: len(values) - (k - size)], values[k - size :]) if k > size and len(values) > k - size else values if k == size else values[:0]


class Windows:
    """The windows of a chunk's documents, in order of document and start, and which of them are still candidates."""

    def __init__(self, docs: pa.Table, width: int):
        ids = pc.fill_null(docs["doc_id"].cast(pa.int64()), NO_ID)
        order = pc.sort_indices(ids)
        docs = docs.take(order)
        self.back = np.argsort(np.asarray(order))
        self.words = tx.words(docs["text"])
        self.width = width
        self.hashes = self.words.hashes(13)[self.words.codes]
        self.row = self.words.rows()
        self.doc = np.asarray(pc.take(ids, order)).astype(np.int64)
        n = max(0, len(self.row) - width + 1)
        self.alive = self.row[:n] == self.row[width - 1 :] if n else np.zeros(0, bool)

    def seeds(self, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which run of w words stands for each candidate window (as an index into the distinct ones); the distinct runs'
        hashes, sorted; and how often each occurs among the runs that stand for a window."""
        run = np.maximum(tx.windows(self.hashes, w, w), np.uint64(1))  # 0 is for windows that are no candidates
        k = self.width - w + 1
        least = sliding(run, k, np.minimum)
        least[~self.alive] = 0
        around = np.zeros(len(run) + k - 1, np.uint64)
        around[k - 1 : k - 1 + len(least)] = least
        chosen = np.flatnonzero((sliding(around, k, np.maximum) == run))
        keys, counts = np.unique(run[chosen], return_counts=True)
        return least, keys, counts

    def survive(self, w: int, totals: np.ndarray) -> None:
        """Windows go whose run of w words is the only one of its kind."""
        least, keys, _ = self.seeds(w)
        if not len(keys):
            self.alive[:] = False
            return
        change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = np.minimum(np.searchsorted(keys, least[change]), len(keys) - 1)
        again = (keys[place] == least[change]) & (totals[place] > 1)
        self.alive &= np.repeat(again, np.diff(np.append(change, len(least))))

    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the candidate windows sorted by hash and start, where each distinct hash begins among them, the distinct
        hashes, and the smallest document of each."""
        starts = np.flatnonzero(self.alive)
        keys = tx.windows(self.hashes, self.width, self.width)[starts]
        order = np.argsort(keys, kind="stable")
        keys, starts = keys[order], starts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return starts, first, keys[first], self.doc[self.row[starts[first]]]

    def removed(self, least: np.ndarray) -> np.ndarray:
        """Which words go, given the smallest document of each distinct window over the whole corpus."""
        starts, first, keys, _ = self.full()
        edge = np.zeros(len(self.row) + 1, np.int64)
        if len(starts):
            row = self.row[starts]
            earlier = np.repeat(least, np.diff(np.append(first, len(starts)))) < self.doc[row]
            again = np.zeros(len(starts), bool)
            again[1:] = row[1:] == row[:-1]
            again[first] = False
            gone = starts[earlier | again]
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + self.width, -1)
        return np.cumsum(edge[:-1]) > 0


def asker(width: int, levels: list[int]):
    """What is asked at the level after those that are answered."""

    def ask(docs: pa.Table, totals: list[np.ndarray]) -> list[ck.Asked]:
        x = Windows(docs, width)
        for w, known in zip(levels, totals):
            x.survive(w, known)
        w = levels[len(totals)]
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return [none] * len(totals) + [x.full()[2:] if w == width else x.seeds(w)[1:]]

    return ask


SCHEMA = "n_words bigint, spans array<struct<a:bigint,b:bigint>>, kept string"


def remover(width: int, levels: list[int]):
    def use(docs: pa.Table, totals: list[np.ndarray]) -> pa.Table:
        x = Windows(docs, width)
        w = x.words
        if len(totals) == len(levels):
            for length, known in zip(levels[:-1], totals):
                x.survive(length, known)
            gone = x.removed(totals[-1])
        else:
            gone = np.zeros(len(x.row), bool)
        kept = np.flatnonzero(~gone)
        at = np.searchsorted(kept, w.at)
        words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), w.vocab.take(pa.array(w.codes[kept])))
        # a run of removed words, cut where a document ends
        new = np.zeros(len(gone) + 1, bool)
        new[w.at] = True
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
        a = np.flatnonzero(gone & (~before | new[:-1]))
        z = np.flatnonzero(gone & (~after | new[1:])) + 1
        base = w.at[x.row[a]] if len(a) else a
        spans = pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(z - base, pa.int64())], ["a", "b"])
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(a, w.at), pa.int32()), spans)
        out = pa.table({"n_words": pa.array(w.n, pa.int64()), "spans": spans, "kept": pc.binary_join(words, " ")}).take(pa.array(x.back))
        return out.add_column(0, "doc_id", docs["doc_id"])

    return use


def dedup(documents: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """For each document row: its id, n_words, the spans [a, b) of the words that go, and what is kept, as words joined by
    one space."""
    if not 1 <= seed <= width:
        raise ValueError("the seed is between 1 and the width")
    kind = documents.schema[doc_id].dataType.simpleString()
    levels = lengths(width, seed)
    packed = ck.Chunks.of(documents, ws, doc_id, text)
    known: DataFrame | None = None
    answered = 0
    for k, w in enumerate(levels):
        ask = asker(width, levels)
        asked = ck.questions(packed, lambda docs, ask=ask: ask(docs, [])) if known is None else ck.asked_on(packed, known, ask, k)
        replies = ws.write(ck.answers(packed, asked, least=w == width), f"replies-{k}")
        known = replies if known is None else known.unionByName(replies)
        answered = k + 1
        if replies.isEmpty():
            break
    found = ck.answered(packed, known, remover(width, levels), f"doc_id {kind}, {SCHEMA}", answered)
    return found.select(F.col("doc_id").alias(doc_id), "n_words", "spans", "kept")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    return dedup(table(spark, sf_dir, "documents"), Workspace(spark, "op13")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB. Windows are compared as space-joined words, which hold no space themselves.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, k, array_to_string(w[k:k + 19], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM w WHERE len(w) >= 20)),
numbered AS (SELECT doc_id, k, row_number() OVER (PARTITION BY p ORDER BY doc_id, k) AS nth FROM win),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS i FROM numbered WHERE nth > 1),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
