"""Quality rules from repetition coverage.

For several n-gram lengths a rolling hash over the words of each text finds n-grams that occur more than once in it; the
share of the text's word characters that lie inside such n-grams is its coverage at that length. The same is measured
for lines that repeat an earlier line. A text whose coverage passes a limit at any length is rejected; nothing else is.

The hash rolls: prefix hashes are made once for a batch and every length takes one difference of them for each word.

The limits are parameters. Their defaults leave room for one passage that stands twice in a text (up to 0.4 of it, so a
quoted or repeated fifth) and tighten with the length, since long repeats are never chance; text that is mostly its own
repetition fails.

Defined results: null or empty text has no words, fails the base rule and isn't kept; ties and repeated rows are judged
each by itself; other columns pass through ``keep`` untouched. All counts are over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import text as tx

#: n-gram length: largest share of word characters inside n-grams of that length found twice or more.
COVERAGE = {5: 0.45, 6: 0.43, 8: 0.40, 10: 0.38, 13: 0.36}
LINE_COVERAGE = 0.40
BASE_LENGTH, BASE_WORDS, BASE_SHARE = 8, 20, 30
BATCH_BYTES = 2 << 20

_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>")).astype(np.int64)
_WORD = (~np.isin(np.arange(256), list(tx.SPACES))).astype(np.int64)
_START = ((np.arange(256) & 0xC0) != 0x80).astype(np.int64)  # bytes that begin a code point

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, coverage array<double>, line_coverage double"


def repeated(keys: np.ndarray, rows: np.ndarray, first_too: bool = True) -> np.ndarray:
    """Which entries have a key that occurs more than once in their row (or, not first_too, an earlier equal one)."""
    own = tx.mix(keys + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind=None if first_too else "stable")
    same = own[order[1:]] == own[order[:-1]]
    out = np.zeros(len(own), bool)
    out[order[1:]] |= same
    if first_too:
        out[order[:-1]] |= same
    return out


def covered(rolling: tx.Rolling, rows: np.ndarray, n: int) -> np.ndarray:
    """Which words lie inside an n-gram that its text holds twice or more."""
    edge = np.zeros(len(rows) + 1, np.int64)
    if len(rows) >= n:
        at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
        starts = at[repeated(rolling.windows(n)[at], rows[at])]
        edge[starts] += 1
        edge[starts + n] -= 1  # starts are distinct, and so are their ends
    return np.cumsum(edge[:-1]) > 0


def measure(column: pa.Array | pa.ChunkedArray, coverage: dict[int, float] = COVERAGE, line_coverage: float = LINE_COVERAGE) -> pa.RecordBatch:
    """A row of SCHEMA for each text."""
    column = tx.plain(column)
    data, at = tx.data_of(column)
    w = tx.split(column)
    rolling, rows, n = tx.Rolling(w.hashes()[w.codes]), w.rows(), w.n
    size = np.asarray(pc.utf8_length(w.vocab)).astype(np.int64)[w.codes]
    chars = tx.sums(size, w.at)
    symbols = tx.sums(_SYMBOL[data], at)
    inside = {k: covered(rolling, rows, k) for k in {*coverage, BASE_LENGTH}}
    repeat_words = tx.sums(inside[BASE_LENGTH].astype(np.int64), w.at)
    shares = np.stack([tx.sums(size * inside[k], w.at) / np.maximum(chars, 1) for k in coverage], 1) if coverage else np.zeros((len(n), 0))

    lists = pc.split_pattern(column, "\n")
    line_at = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.slice(line_at[0], line_at[-1] - line_at[0]).dictionary_encode()
    vocab, line_at = coded.dictionary, line_at - line_at[0]
    line_data, ends = tx.data_of(tx.plain(vocab))
    line_chars = tx.sums(_WORD[line_data] * _START[line_data], ends)
    codes = np.asarray(coded.indices).astype(np.int64)
    line_rows = np.repeat(np.arange(len(n)), np.diff(line_at))
    dup = repeated(codes.astype(np.uint64), line_rows, first_too=False) & (line_chars[codes] > 0)
    dup_lines = tx.sums(dup.astype(np.int64), line_at)
    twice = repeated(codes.astype(np.uint64), line_rows)
    in_lines = tx.sums(line_chars[codes] * twice, line_at) / np.maximum(chars, 1)

    failed = (n < BASE_WORDS) | (100 * repeat_words > BASE_SHARE * n)
    kept = ~failed & (in_lines <= line_coverage)
    for k, most in enumerate(coverage.values()):
        kept &= shares[:, k] <= most
    out = [*(pa.array(x, pa.int64()) for x in (n, chars, symbols, dup_lines, repeat_words)), pa.array(failed), pa.array(kept)]
    flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * shares.shape[1], pa.int32()), pa.array(shares.ravel(), pa.float64()))
    return pa.RecordBatch.from_arrays([*out, flat, pa.array(in_lines, pa.float64())], names=[x.split()[0] for x in SCHEMA.split(", ")])


def report(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """doc_id and the measures and verdicts of each document row."""
    df = documents.select(F.col(doc_id).alias("_doc_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "_text", BATCH_BYTES):
            m = measure(b.column("_text"), **limits)
            yield pa.RecordBatch.from_arrays([b.column("_doc_id"), *m.columns], names=["_doc_id", *m.schema.names])

    return df.mapInArrow(run, f"_doc_id {df.schema['_doc_id'].dataType.simpleString()}, {SCHEMA}").withColumnRenamed("_doc_id", doc_id)


def keep(documents: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows whose text is kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, text, BATCH_BYTES):
            yield b.filter(measure(b.column(text), **limits).column("kept"))

    return documents.mapInArrow(run, documents.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigmill.llm.workspace import table

    return report(table(spark, sf_dir, "documents")).drop("coverage", "line_coverage")


#: DuckDB. Words hold no white space, so n-grams are compared as space-joined words.
ORACLE_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT rn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
grams AS (
  SELECT rn, m, k, array_to_string(w[k:k + m - 1], ' ') AS g
  FROM (SELECT rn, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (VALUES LENGTHS) l(m) WHERE len(w) >= m)),
twice AS (SELECT rn, m, k FROM grams QUALIFY count(*) OVER (PARTITION BY rn, m, g) > 1),
inside AS (SELECT DISTINCT rn, m, unnest(range(k, k + m)) AS i FROM twice),
cover AS (SELECT rn, m, count(*) AS n, sum(length(word)) AS chars FROM inside JOIN words USING (rn, i) GROUP BY rn, m),
lines AS (SELECT rn, line, pos, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (SELECT rn, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT rn, string_split(text, chr(10)) AS l FROM d))),
marked AS (SELECT rn, chars, row_number() OVER (PARTITION BY rn, line ORDER BY pos) AS nth, count(*) OVER (PARTITION BY rn, line) AS times FROM lines WHERE chars > 0),
by_line AS (SELECT rn, count(*) FILTER (nth > 1) AS dup, coalesce(sum(chars) FILTER (times > 1), 0) AS chars FROM marked GROUP BY rn),
base AS (
  SELECT d.rn, doc_id, len(w) AS n_words, coalesce((SELECT sum(length(word)) FROM words WHERE words.rn = d.rn), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(by_line.chars, 0) AS line_chars, coalesce(c8.n, 0) AS n_repeat_words
  FROM d LEFT JOIN by_line ON by_line.rn = d.rn LEFT JOIN cover c8 ON c8.rn = d.rn AND c8.m = 8),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS failed,
    EXISTS (SELECT 1 FROM cover JOIN (VALUES LIMITS) t(m, most) ON t.m = cover.m WHERE cover.rn = base.rn AND CAST(cover.chars AS DOUBLE) / greatest(base.word_chars, 1) > most) AS covered
  FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed AS base_failed,
  NOT failed AND NOT covered AND CAST(line_chars AS DOUBLE) / greatest(word_chars, 1) <= LINES AS kept
FROM judged
""".replace("LENGTHS", ", ".join(f"({n})" for n in COVERAGE))
    .replace("LIMITS", ", ".join(f"({n}, CAST({x} AS DOUBLE))" for n, x in COVERAGE.items()))
    .replace("LINES", f"CAST({LINE_COVERAGE} AS DOUBLE)")
)
