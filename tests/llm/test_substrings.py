"""Substring removal against a plain version of its contract."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sigmill.llm import substrings
from sigmill.llm.workspace import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, width):
    """(id, text) rows to their (n_words, removed places)."""
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    key = lambda i: float("inf") if i is None else i
    for (i, _), w in zip(rows, split):
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            first[x] = min(first.get(x, float("inf")), key(i))
    out = []
    for (i, _), w in zip(rows, split):
        gone, seen = set(), set()
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in seen or first[x] < key(i):
                gone.update(range(k, k + width))
            seen.add(x)
        out.append((i, len(w), gone, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def same(spark, rows, width, seed, parts=3):
    df = spark.createDataFrame([(n, i, t) for n, (i, t) in enumerate(rows)], "n long, doc_id long, text string").withColumns({"spans": F.lit(1), "kept": F.lit("x"), "chunk": F.lit(2)})
    got = substrings.dedup(df.repartition(parts), Workspace(spark, "t13"), width=width, seed=seed).collect()
    want = plain(rows, width)
    flat = lambda r: tuple(k for s in r.spans for k in range(s.a, s.b))
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_words, flat(r), r.kept) for r in got), key=order) == sorted(((i, n, tuple(sorted(g)), t) for i, n, g, t in want), key=order)


def rows_of(seed, n, words, most):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, most))) for _ in range(n)]
    texts += [texts[k] for k in (3, 3, 5)] + [texts[1] + "\t " + texts[2] + "\n" + texts[1], texts[4].upper(), None, "", " \n", "x", "a\u00a0b \u2003 c " * 9]
    rows = list(zip(rng.sample(range(1000), len(texts)), texts))
    return rows + [(None, texts[6]), (None, texts[6]), (rows[7][0], texts[7]), (rows[7][0], texts[8])]


@pytest.mark.parametrize("width, seed", [(4, 1), (4, 4), (5, 2), (3, 3), (1, 1)])
def test_small_alphabet(spark, width, seed):
    """Every window is repeated somewhere, many overlap themselves."""
    same(spark, rows_of(width, 25, ["a", "b"], 40), width, seed)


@pytest.mark.parametrize("seed", [5, 10, 20, 7])
def test_passages(spark, seed):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = rows_of(9, 30, words, 200)
    for k in range(12):
        own = [rng.choice(words) for _ in range(100)]
        rows.append((2000 + 7 * k % 30, " ".join(own[:40] + passage[k % 5 : 60 - k] + own[40:])))
    rows += [(5000, " ".join(passage[:20])), (5001, " ".join(passage[:19])), (5002, "la " * 5000), (-3, " ".join(passage[30:]))]
    same(spark, rows, 20, seed)


def test_levels():
    assert substrings.lengths(20, 5) == [5, 10, 20] and substrings.lengths(20, 20) == [20] and substrings.lengths(20, 3) == [3, 6, 12, 20] and substrings.lengths(1, 1) == [1]


def test_nothing_survives(spark):
    """The run ends at the first level; no table of a later one is written."""
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b x y z u v w q " * 1)], "doc_id long, text string")
    assert [(r.doc_id, r.spans, r.kept) for r in substrings.dedup(df, Workspace(spark, "t13"), width=6, seed=3).orderBy("doc_id").collect()] == [(1, [], "a b c d e f"), (2, [], "a b x y z u v w q")]
    assert substrings.dedup(df.filter("false"), Workspace(spark, "t13")).count() == 0


def test_digest(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(30))
    spark.createDataFrame([(1, text), (2, "new " + text + " end")], "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in substrings.op13_substrings(spark, str(tmp_path)).collect()}
    assert (got[1].n_words, got[1].n_removed) == (30, 0) and (got[2].n_words, got[2].n_removed) == (32, 30)
    assert got[2].kept_sha256 == hashlib.sha256(b"new end").hexdigest()
