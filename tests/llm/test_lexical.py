"""Ranked search against a plain version of the contract."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm import lexical
from sigmill.llm.workspace import Workspace

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, top=10):
    held = [(i, w) for i, t in docs if (w := terms(t))]
    n_docs, n_words = len(held), sum(len(w) for _, w in held)
    df = collections.Counter(t for _, w in held for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in held:
            tf, m = collections.Counter(w), 100 - 75 + (75 * len(w) * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if s > 0:
                scored.append((s, i))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, k + 1, i, s) for k, (s, i) in enumerate(scored[:top])]
    return out


def texts():
    rng = random.Random(4)
    words = [f"Wort{k}" for k in range(60)]
    docs = [" ".join(words[int(rng.paretovariate(0.7)) % 60] for _ in range(rng.randint(1, 90))) for _ in range(150)]
    docs += [docs[3]] * 25 + ["", None, " ,; ", "x", "ÄÖ ß日本 naïve-Wort1", docs[7].upper(), "wort1 " * 3000]
    ids = rng.sample(range(1000), len(docs))
    docs = list(zip(ids, docs)) + [(None, docs[3]), (None, docs[3]), (ids[0], docs[0]), (ids[0], "wort1 wort2")]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for k in range(12)]
    items += [(20, docs[3][1]), (21, None), (22, " - "), (23, "unknown"), (None, "Wort1 wort1 WORT2"), (3, "wort5"), (24, "wort1"), (25, "ß日本 äÖ")]
    return docs, items


key = lambda x: tuple((y is None, y or 0) for y in x)


@pytest.mark.parametrize("block, shard", [(lexical.BLOCK_TERMS, lexical.SHARD_BYTES), (20, 900)])
def test_search(spark, monkeypatch, block, shard):
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    rows, items = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "n": F.lit(1), "term": F.lit(2), "rank": F.lit(3)}).repartition(3)
    bench = spark.createDataFrame(items, "item_id int, text string").withColumn("number", F.lit(1))
    got = lexical.search(docs, bench, Workspace(spark, "t12"), block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, items), key=key)
    assert sorted(map(tuple, lexical.search(docs, bench, Workspace(spark, "t12"), top=3).collect()), key=key) == sorted(plain(rows, items, 3), key=key)


def test_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    for d, b in ((docs.filter("false"), bench), (docs, bench.filter("false")), (docs, bench.withColumn("text", F.lit("-"))), (docs.withColumn("text", F.lit(None).cast("string")), bench)):
        got = lexical.search(d, b, Workspace(spark, "t12"))
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_blocks_have_the_least_error():
    """The dynamic program against all ways to cut short lists."""
    rng = random.Random(6)
    lists = [[rng.randint(0, 50) for _ in range(n)] for n in (1, 2, 7, 9, 9, 4, 10)]
    start = np.cumsum([0, *map(len, lists)])
    for longest, penalty in ((64, 1.0), (3, 0.5), (4, 3.0), (1, 1.0)):
        got = lexical.cuts(np.array(sum(lists, [])), start, longest, penalty)
        for own, a, b in zip(lists, start, start[1:]):
            cost = lambda cut: sum(max(own[x:y]) * (y - x) - sum(own[x:y]) + penalty * sum(own) / len(own) for x, y in zip(cut, cut[1:]))
            every = [(0, *c, len(own)) for r in range(len(own)) for c in itertools.combinations(range(1, len(own)), r)]
            least = min(cost(c) for c in every if max(y - x for x, y in zip(c, c[1:])) <= longest)
            mine = [int(x - a) for x in got if a <= x < b] + [len(own)]
            assert mine[0] == 0 and max(np.diff(mine)) <= longest and abs(cost(mine) - least) < 1e-6


def test_stretches_are_skipped():
    """Far fewer documents are scored than hold a term of the query, and the results are those of scoring all."""
    rng = np.random.default_rng(8)
    size, common, rare = 4000, np.arange(0, 4000, 2), np.sort(rng.choice(4000, 40, False))
    tf = [rng.integers(1, 4, len(common)), rng.integers(1, 9, len(rare))]
    import pyarrow as pa

    flat = {"ids": np.arange(size), "n": rng.integers(50, 400, size), "term": np.array([0, 1]), "start": np.array([0, len(common), len(common) + len(rare)]), "doc": np.concatenate([common, rare]), "tf": np.concatenate(tf)}
    shard = lexical.Shard({k: pa.scalar(v.tolist(), pa.list_(pa.int64())) for k, v in flat.items()}, size, int(flat["n"].sum()))
    best, weight = lexical.Best(10), np.array([50, 6000])
    scored = lexical.search_shard(shard, np.array([0, 1]), weight, best)
    total = np.zeros(size, np.int64)
    np.add.at(total, shard.doc, shard.score * np.repeat(weight, np.diff(shard.start)))
    order = np.lexsort((np.arange(size), -total))[:10]
    assert best.id.tolist() == order.tolist() and best.score.tolist() == total[order].tolist()
    assert scored < 0.6 * np.count_nonzero(total)
    assert search_again(shard, weight, best) < 0.03 * np.count_nonzero(total)  # a shard that comes later


def search_again(shard, weight, best):
    return lexical.search_shard(shard, np.array([0, 1]), weight, best)
