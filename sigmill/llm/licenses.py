"""Licence scan with a generalised suffix automaton of licence words.

The automaton holds every run of consecutive words of every template. A text is streamed through it word by word; at
each word its state gives the longest run of the templates that ends there (the matching statistics). Runs of at least
``LEAST`` words that can't be lengthened are placed on the templates they come from and chained: in order, in the text
and in the template, without overlap, with at most ``GAP`` words left out between them. A chain that covers enough of a
template labels the text (``COVERED`` of it; a template of ``SHORT`` words or fewer, all but one word, so that a licence's
name alone is no notice). Where chains of several templates lie over the same words, the one with more matched words
stands, so a licence isn't mistaken for a relative that shares its phrases.

Templates are short licences and notices, and the sections of long licences' full texts: paragraphs, put together until
they hold ``SECTION`` words. A section of which another licence has more than ``SHARED`` of the five-word runs tells
nothing of its licence and is no template. So a full text, a part of it and an edited one are all found by their sections.

Only stretches of ``LEAST`` or more consecutive words known to the templates are streamed, since no other stretch can
hold a long match. Besides, short phrases label a text by themselves wherever they stand (the base labels).

Defined results: null or empty text has no words, no places, empty label strings and score 0; repeated rows are judged
each by itself; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from importlib import resources

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import text as tx

LEAST, GAP, COVERED, SHORT = 4, 6, 0.75, 8
SECTION, SHARED = 60, 0.4
BATCH_BYTES = 4 << 20

#: label: the files of full texts
FULL_TEXTS = {"apache-2": ["Apache-2.0"], "cc0": ["CC0-1.0"], "gpl-2": ["GPL-2"], "gpl-3": ["GPL-3"], "lgpl": ["LGPL-2.1", "LGPL-3"], "mpl-2": ["MPL-2.0"]}

#: phrase: label
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@cache
def default_templates() -> tuple[tuple[str, str], ...]:
    """(label, text) of the notices and short licences in the data file, and of the full texts' sections."""
    lines = resources.files("sigmill.llm").joinpath("data/licences.txt").read_text("utf-8").splitlines()
    return (*(tuple(x.split("\t", 1)) for x in lines if x and not x.startswith("#")), *sections(full_texts()))


@cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """(label, text) of the long licences."""
    folder = resources.files("sigmill.llm").joinpath("data/full")
    return tuple((label, folder.joinpath(f"{name}.txt").read_text("utf-8")) for label, names in FULL_TEXTS.items() for name in names)


def sections(texts: Iterable[tuple[str, str]], size: int = SECTION, shared: float = SHARED) -> list[tuple[str, str]]:
    """(label, text) of the sections of each text that no other label's texts share."""
    texts = list(texts)
    runs: dict[str, set[str]] = {}
    for label, text in texts:
        runs.setdefault(label, set()).update(_runs(text))
    out = []
    for label, text in texts:
        parts = [""]
        for paragraph in text.split("\n\n"):
            if len(_words(parts[-1])) >= size:
                parts.append("")
            parts[-1] += paragraph + "\n\n"
        if len(parts) > 1 and len(_words(parts[-1])) < size:
            parts[-2:] = ["".join(parts[-2:])]
        others = [r for other, r in runs.items() if other != label]
        out += [(label, part) for part in parts if (own := _runs(part)) and all(len(own & r) <= shared * len(own) for r in others)]
    return out


def _words(text: str) -> list[str]:
    w = tx.words(pa.array([text], pa.string()), tx.ALNUM)
    return w.vocab.take(pa.array(w.codes)).to_pylist()


def _runs(text: str) -> set[str]:
    words = _words(text)
    return {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, min(1, len(words))))}


class Automaton:
    """Generalised suffix automaton of word sequences. Its size is linear in theirs: a state keeps only the places where
    its longest run ends as a prefix of a sequence; all its places are those of the states that link to it as well."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [[]]
        for number, words in enumerate(sequences):
            state = 0
            for at, word in enumerate(words):
                state = self._add(state, word)
                self.ends[state].append((number, at + 1))
        self.below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            self.below[self.link[state]].append(state)

    def places(self, state: int) -> Iterator[tuple[int, int]]:
        """(sequence, end) of each place where the state's runs end."""
        todo = [state]
        while todo:
            state = todo.pop()
            yield from self.ends[state]
            todo += self.below[state]

    def _new(self, length: int, to: dict, link: int) -> int:
        self.next.append(to)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        if self.length[p] + 1 == self.length[q]:
            return q
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        own = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = own
            p = self.link[p]
        if p >= 0:
            self.link[own] = self._split(p, word, self.next[p][word])
        return own

    def matches(self, words: list[int], least: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of each longest match of least words or more that the next word doesn't lengthen."""
        out, state, length = [], 0, 0
        for i, word in enumerate(words):
            to = self.next[state].get(word)
            if to is None:
                if length >= least:
                    out.append((i, length, state))
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                to = self.next[state].get(word)
            if to is None:
                state, length = 0, 0
            else:
                state, length = to, length + 1
        if length >= least:
            out.append((len(words), length, state))
        return out


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [x for x, _ in templates]
        w = tx.words(pa.array([t for _, t in templates] + list(phrases), pa.string()), tx.ALNUM)
        rows = [w.codes[a:b].tolist() for a, b in zip(w.at, w.at[1:])]
        self.vocab, self.sizes = w.vocab, [len(r) for r in rows[: len(templates)]]
        self.automaton = Automaton(rows[: len(templates)])
        self.phrases = list(zip(rows[len(templates) :], phrases.values()))
        self.least = min([LEAST, *self.sizes])
        self.needed = [max(COVERED * n, n - 1 if n <= SHORT else 0) for n in self.sizes]

    def chains(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(matched words, template, first, end) of the best chain of each template that covers enough of it."""
        places: dict[int, list[tuple[int, int, int]]] = {}
        for end, length, state in found:
            for template, to in self.automaton.places(state):
                places.setdefault(template, []).append((end, to, length))
        out = []
        for template, own in places.items():
            own.sort()
            best: list[tuple[int, int]] = []  # matched words, first word
            for k, (end, to, length) in enumerate(own):
                score, first = length, end - length
                for j in range(k - 1, -1, -1):
                    e, t, _ = own[j]
                    if end - length - e > GAP:  # chains only reach so far back
                        break
                    if e <= end - length and 0 <= to - length - t <= GAP and best[j][0] + length > score:
                        score, first = best[j][0] + length, best[j][1]
                best.append((score, first))
            out += [(s, template, first, own[k][0]) for k, (s, first) in enumerate(best) if s >= self.needed[template]]
        return out

    def licences(self, words: list[int]) -> dict[str, tuple[float, list[tuple[int, int]]]]:
        """Label: coverage and word spans, for one stretch of known words (-1 for words that templates lack)."""
        kept: list[tuple[int, int, int, int]] = []
        found = self.chains(self.automaton.matches(words, self.least))
        for c in sorted(found, key=lambda c: (-c[0], c[0] - self.sizes[c[1]], c[1], c[2])):
            if all(c[3] <= k[2] or c[2] >= k[3] for k in kept):
                kept.append(c)
        out: dict[str, tuple[float, list[tuple[int, int]]]] = {}
        for matched, template, first, end in kept:
            cover, spans = out.get(self.labels[template], (0.0, []))
            out[self.labels[template]] = (max(cover, matched / self.sizes[template]), [*spans, (first, end)])
        return out

    def scan(self, column: pa.Array) -> list[dict]:
        w = tx.words(column, tx.ALNUM)
        rows = len(w.at) - 1
        known = np.asarray(pc.fill_null(pc.index_in(w.vocab, self.vocab), -1)).astype(np.int64)
        codes = known[w.codes] if len(w.codes) else np.zeros(0, np.int64)
        out = [{"n_words": int(n), "places": [], "base": set(), "found": {}} for n in w.n]
        for words, label in self.phrases:
            at = np.arange(max(0, len(codes) - len(words) + 1))
            for k, word in enumerate(words):
                at = at[codes[at + k] == word]
            row = np.searchsorted(w.at, at, "right") - 1
            inside = at + len(words) <= w.at[row + 1]
            for r, i in zip(row[inside].tolist(), at[inside].tolist()):
                out[r]["places"].append(i - int(w.at[r]))
                out[r]["base"].add(label)
        # stretches of known words, joined over gaps that a chain may span
        hit = np.flatnonzero(codes >= 0)
        if len(hit):
            row = np.searchsorted(w.at, hit, "right") - 1
            run_cut = np.flatnonzero((np.diff(hit) > 1) | (np.diff(row) > 0)) + 1
            first, last = hit[np.concatenate([[0], run_cut])], hit[np.append(run_cut, len(hit)) - 1]
            long = last - first + 1 >= self.least
            first, last = first[long], last[long]
            row = np.searchsorted(w.at, first, "right") - 1
            join = np.flatnonzero((first[1:] - last[:-1] > GAP + 1) | (np.diff(row) > 0)) + 1 if len(first) else np.zeros(0, np.int64)
            starts, ends = (first[np.concatenate([[0], join])], last[np.append(join, len(last)) - 1]) if len(first) else (first, last)
            for a, b in zip(starts.tolist(), ends.tolist()):
                r = int(np.searchsorted(w.at, a, "right") - 1)
                for label, (cover, spans) in self.licences(codes[a : b + 1].tolist()).items():
                    before, had = out[r]["found"].get(label, (0.0, []))
                    out[r]["found"][label] = (max(before, cover), had + [(x + a - int(w.at[r]), y + a - int(w.at[r])) for x, y in spans])
        assert len(out) == rows
        return out


@lru_cache(4)
def _scanner(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Scanner:
    """One for all tasks of a worker."""
    return Scanner(list(templates), dict(phrases))


SCHEMA = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,first:bigint,end:bigint>>"


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] = PHRASES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and SCHEMA for each document row; spans: the covered words [first, end) of each label that chains give."""
    df = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    templates, phrases = tuple(map(tuple, templates or default_templates())), tuple(phrases.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, phrases)
        for b in tx.slices(batches, "_text", BATCH_BYTES):
            found = scanner.scan(b.column("_text"))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([x["n_words"] for x in found], pa.int64()),
                    pa.array([len(x["places"]) for x in found], pa.int64()),
                    pa.array([min(x["places"], default=None) for x in found], pa.int64()),
                    pa.array([max(x["places"], default=None) for x in found], pa.int64()),
                    pa.array([",".join(sorted(x["base"])) for x in found], pa.string()),
                    pa.array([",".join(sorted(x["base"] | set(x["found"]))) for x in found], pa.string()),
                    pa.array([1.0 if x["base"] else max([0.0, *(min(1.0, c) for c, _ in x["found"].values())]) for x in found], pa.float64()),
                    pa.array([[{"label": k, "first": a, "end": z} for k, (_, s) in sorted(x["found"].items()) for a, z in s] for x in found], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))],
            )

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sigmill.llm.workspace import table

    return scan(table(spark, sf_dir, "documents")).drop("spans")
