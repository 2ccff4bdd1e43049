"""Words and hashes of whole Arrow text columns, without a Python step per word.

Byte rules are tables of 256 entries applied to the column's UTF-8 buffer. They only ever change ASCII bytes, so the
result is valid UTF-8 with the same offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACES = bytes([0x20, *range(0x09, 0x0E)])
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_R33 = np.uint64(33)


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


#: A-Z to a-z, all else as it is.
LOWER = _lower()
#: Also all ASCII but digits and letters to a space: the words are then ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.where((np.arange(256) >= 0x80) | np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]), LOWER, 0x20).astype(np.uint8)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """One contiguous string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.type != pa.string():
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def data_of(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The text bytes of a column, and where each row starts and the last ends in them."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return own, at - at[0]


def of_data(data: np.ndarray, at: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def mapped(column: pa.StringArray, table: np.ndarray) -> pa.StringArray:
    data, at = data_of(column)
    return of_data(table[data], at)


@dataclass
class Words:
    """codes: of all words of all rows; row i has codes[at[i]:at[i + 1]]; vocab: the distinct words."""

    codes: np.ndarray
    at: np.ndarray
    vocab: pa.StringArray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.at)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.n)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """Of the distinct words, 64 bits each."""
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocab.to_pylist()), np.uint64, len(self.vocab))


def split(column: pa.StringArray) -> Words:
    """Words between ASCII white space (0x20, 0x09-0x0D)."""
    lists = pc.ascii_split_whitespace(column)
    at = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    codes, at = np.asarray(coded.indices).astype(np.int64), at - at[0]
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # from white space at either end of a text
        keep = codes != empty
        at = np.concatenate([[0], np.cumsum(keep)])[at]
        codes = codes[keep]
    return Words(codes, at, coded.dictionary)


def words(column: pa.Array | pa.ChunkedArray, table: np.ndarray | None = None) -> Words:
    column = plain(column)
    return split(column if table is None else mapped(column, table))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> _R33)
    x = x * _M1
    x ^= x >> _R33
    x = x * _M2
    return x ^ (x >> _R33)


def odd(n: int, seed: int = 0) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def windows(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of each run of ``width`` consecutive values, whatever row they are in."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, m in enumerate(odd(width, seed)):
        out += values[k : k + n] * m
    return mix(out)


class Rolling:
    """A rolling hash mod 2**64 as prefix hashes: that of any run of values is one difference, shifted back to its start."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, values: np.ndarray):
        n = len(values)

        def powers(base: int) -> np.ndarray:
            out = np.full(n + 1, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(self.BASE)[:n], dtype=np.uint64)])
        self.back = powers(pow(self.BASE, -1, 1 << 64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of each run of ``width`` consecutive values, whatever row they are in."""
        n = max(0, len(self.prefix) - width)
        return mix((self.prefix[width:] - self.prefix[:n]) * self.back[:n])


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. counts[0]-1, 0, 1, .. counts[1]-1, ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i + 1]] for each i, empty runs too; wraps as integers do."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[at[1:]] - total[at[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in pieces of about ``most`` bytes of the text column; a longer text is a piece of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        block = np.cumsum(np.asarray(sizes).astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
