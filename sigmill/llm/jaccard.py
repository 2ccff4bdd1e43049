"""N-gram Jaccard join with filters under several global token orders.

Tokens are the distinct shingles of a text. Under any one order of all tokens, two sets with Jaccard similarity of t or
more share a token among the first n - ceil(t n) + 1 of each (its prefix). Two orders are used here: by document
frequency with ties by a hash, and by a hash into ``CLASSES`` classes first and by frequency only within a class, so that
the second prefix takes the rarer ones of another choice of tokens. Pairs must pass both filters before they are
verified. Shingles are compared by 64-bit hashes, in the filters and in the verification. A token that only one distinct
text holds links nothing and is left out; most texts then have no candidates at all, and only the rest go on.

``link`` gives one row per document with its component, so no list of all pairs is made:

1. equal sets are one node, whatever the number of copies;
2. nodes are put in blocks: components of "shares a token of the first prefix", and within these of "shares a token of
   the second prefix", by links from each node to the smallest node of a token, never among all of a token's nodes;
3. small blocks are joined in one task. A larger one is cut in pieces, each joined within itself and with a few leaders
   of the block; what doesn't end in the block's main component then meets every piece of the block. So every pair of
   nodes that passes both filters is verified, but for pairs already in one component;
4. the components of the links are the result.

``pairs`` gives the links themselves, between one document of each set, with the sets' members: there every candidate pair
is verified, in one component or not, so a block of n nodes costs as many comparisons as it has candidates.

Defined results: null or empty text, or one without words, has no shingles and links with nothing (its component is
itself); repeated rows are copies; a null id doesn't name a component unless its rows have no other; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigmill.llm import chunks as ck
from sigmill.llm import text as tx
from sigmill.llm.graph import components
from sigmill.llm.workspace import Workspace, table

WIDTH = 5
PERCENT = 80
TILE = 512
LEADERS = 24
#: What a node with its set weighs in a table, in plain rows.
NODE_ROWS = 10
CLASSES = 3
_SALT_B = np.uint64(0xA0761D6478BD642F)


class Sets:
    """The shingle sets of a chunk's documents: items[at[i]:at[i + 1]], sorted and distinct."""

    def __init__(self, docs: pa.Table, width: int):
        w = tx.words(docs["text"], tx.LOWER)
        hashes, rows, n = w.hashes()[w.codes], w.rows(), w.n
        full = tx.windows(hashes, width)
        ok = rows[: len(full)] == rows[width - 1 :] if len(full) else np.zeros(0, bool)
        items, owner = full[ok], rows[: len(full)][ok]
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            mul = tx.odd(width, 1)
            one = [tx.mix((hashes[w.at[i] : w.at[i + 1]] * mul[: n[i]]).sum(keepdims=True) + np.uint64(n[i]))[0] for i in short]
            where = np.searchsorted(owner, short)
            items, owner = np.insert(items, where, one), np.insert(owner, where, short)
        start = np.searchsorted(owner, np.arange(len(n) + 1))
        for a, b in zip(start[:-1], start[1:]):
            items[a:b].sort()
        keep = np.ones(len(items), bool)
        keep[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
        self.items, owner = items[keep], owner[keep]
        self.at = np.searchsorted(owner, np.arange(len(n) + 1))
        self.n = np.diff(self.at)
        self.sig = np.stack([tx.sums(tx.mix(self.items * m), self.at) for m in tx.odd(2, 99)], 1)
        _, first = np.unique(self.sig.view("V16").ravel(), return_index=True)
        self.first = np.zeros(len(n), bool)  # the chunk's first document with its set
        self.first[first] = True
        self.first &= self.n > 0
        self.own = np.repeat(self.first, self.n)


def asker(width: int) -> ck.Asker:
    def ask(docs: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
        s = Sets(docs, width)
        return [np.unique(s.items[s.own], return_counts=True)]

    return ask


def least(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """ceil(percent / 100 * n)"""
    return -(-percent * n // 100)


SCHEMA = "n_shingles bigint, sig string, a array<bigint>, b array<bigint>, body binary"


def user(width: int, percent: int):
    def use(docs: pa.Table, totals: list[np.ndarray]) -> pa.Table:
        s = Sets(docs, width)
        which = np.flatnonzero(s.own)
        _, inverse = np.unique(s.items[which], return_inverse=True)
        df = np.ones(len(s.items), np.int64)
        df[which] = totals[0][inverse]
        prefix = s.n - least(s.n, percent) + 1
        alone = tx.sums((df == 1).astype(np.int64), s.at)
        size = len(s.n)
        a, b, body = [None] * size, [None] * size, [None] * size
        for i in np.flatnonzero(s.first & (alone < prefix)):
            items, f = s.items[s.at[i] : s.at[i + 1]], df[s.at[i] : s.at[i + 1]]
            order_a = np.lexsort((items, f))[: prefix[i]]
            other = tx.mix(items ^ _SALT_B)
            order_b = np.lexsort((other, f, other % np.uint64(CLASSES)))[: prefix[i]]
            first, second = items[order_a[f[order_a] > 1]], items[order_b[f[order_b] > 1]]
            if len(first) and len(second):
                a[i], b[i], body[i] = first.view(np.int64), second.view(np.int64), items.tobytes()
        sig = [x.hex() if n else None for x, n in zip(map(bytes, s.sig.view("V16").ravel()), s.n)]
        return pa.table({"doc_id": docs["doc_id"], "n_shingles": pa.array(s.n, pa.int64()), "sig": pa.array(sig, pa.string()), "a": pa.array(a, pa.list_(pa.int64())), "b": pa.array(b, pa.list_(pa.int64())), "body": pa.array(body, pa.binary())})

    return use


def stars(nodes: DataFrame, within: list[str], tokens: str) -> DataFrame:
    """u, v: from each node to the smallest node that shares a token (and the columns within)."""
    each = nodes.select(*within, "sig", F.explode(tokens).alias("token"))
    hub = each.groupBy(*within, "token").agg(F.min("sig").alias("v"), F.max("sig").alias("_most")).filter("v <> _most").drop("_most")
    return each.join(hub, [*within, "token"]).select(F.col("sig").alias("u"), "v").filter("u <> v").distinct()


def joiner(percent: int, every: bool = False):
    """Verified links among the rows of a tile; side 0 rows meet all rows, side 1 rows only those of side 0. Unless every
    link is wanted, a candidate pair that is in one component already isn't verified."""

    def run(t: pa.Table) -> pa.Table:
        sig, label = t["sig"].to_pylist(), t["label"].to_pylist()
        side = t["side"].to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in t["body"].to_pylist()]
        a, b = t["a"].to_pylist(), t["b"].to_pylist()
        order = sorted(range(len(sig)), key=lambda i: (len(sets[i]), sig[i], side[i]))
        head: dict = {}

        def root(x):
            while (up := head.get(x, x)) != x:
                head[x] = head.get(up, up)
                x = up
            return x

        by_a: dict[int, list[int]] = {}
        by_b: dict[int, list[int]] = {}
        links = []
        for i in order:
            one = {j for x in a[i] for j in by_a.get(x, ())}
            both = one & {j for x in b[i] for j in by_b.get(x, ())} if one else one
            n = len(sets[i])
            for j in sorted(both, reverse=True):
                m = len(sets[j])
                if (side[i] and side[j]) or 100 * m < percent * n or (not every and root(label[i]) == root(label[j])):
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (n + m - shared):
                    links.append((sig[i], sig[j]))
                    head[root(label[i])] = root(label[j])
            for x in a[i]:
                by_a.setdefault(x, []).append(i)
            for x in b[i]:
                by_b.setdefault(x, []).append(i)
        return pa.table({"u": pa.array([x for x, _ in links], pa.string()), "v": pa.array([y for _, y in links], pa.string())})

    return run


def in_blocks(documents: DataFrame, ws: Workspace, doc_id: str, text: str, width: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """The documents' sets; the nodes (sig, a, b, body) with the block that holds all their candidates, and its size; and
    how many nodes there are at most."""
    kind = documents.schema[doc_id].dataType.simpleString()
    packed = ck.Chunks.of(documents, ws, doc_id, text)
    replies = ws.write(ck.answers(packed, ck.questions(packed, asker(width))), "totals")
    sets = ws.write(ck.answered(packed, replies, user(width, percent), f"doc_id {kind}, {SCHEMA}"), "sets")
    ws.drop("chunks", "totals")

    some = sets.filter(F.col("a").isNotNull())
    found = some.count()
    nodes = ws.write(some.select("sig", "a", "b", "body").dropDuplicates(["sig"]), "nodes", NODE_ROWS * found)
    first = components(stars(nodes, [], "a"), ws, "block-a", 4 * found)
    blocked = nodes.join(first.withColumnRenamed("node", "sig"), "sig").withColumnRenamed("label", "first")
    second = components(stars(blocked, ["first"], "b"), ws, "block-b", 4 * found)
    size = second.groupBy("label").agg(F.count("*").alias("size"))
    of = second.join(size, "label").select(F.col("node").alias("sig"), F.col("label").alias("block"), "size")
    return sets, ws.write(nodes.join(of, "sig"), "blocked", NODE_ROWS * found), found


def pairs(documents: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, class_id) for each document row, class_id being the smallest id with the same set; and (u, v),
    u < v, for every link between two classes. A document without words is a class of its own without links.

    A block beyond tile nodes is cut in pieces; each two pieces meet in one task, which verifies the pairs across them.
    """
    sets, blocked, _ = in_blocks(documents, ws, doc_id, text, width, percent)
    pieces = F.ceil(F.col("size") / tile).cast("long")
    own = F.pmod(F.xxhash64("sig"), pieces)
    meet = blocked.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    tiles = meet.select("block", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "sig", "a", "b", "body", F.col("sig").alias("label"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"))
    # p < q: those of piece p are side 0 and meet all; what they have among themselves comes from the tile (p, p) as well
    links = ws.write(tiles.groupBy("block", "p", "q").applyInArrow(joiner(percent, True), "u string, v string"), "pairs").distinct()
    own_id = sets.groupBy("sig").agg(F.min("doc_id").alias("class_id"))
    members = sets.join(own_id.filter("sig IS NOT NULL"), "sig", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"))
    name = lambda x: own_id.select(F.col("sig").alias(x), F.col("class_id").alias(f"{x}_id"))
    both = links.join(name("u"), "u").join(name("v"), "v")
    return members, both.select(F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v"))


def link(documents: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) for each document row."""
    sets, blocked, found = in_blocks(documents, ws, doc_id, text, width, percent)
    at = F.pmod(F.xxhash64("sig"), F.lit(1 << 40))
    piece = F.when(F.col("size") <= tile, F.lit(0)).otherwise(F.pmod(at, F.ceil(F.col("size") / tile).cast("long")))
    cut = blocked.withColumn("piece", piece.cast("long"))
    leads = cut.filter((F.col("size") > tile) & (F.pmod(F.xxhash64("sig", F.lit(7)), F.lit(1 << 40)) / float(1 << 40) * F.col("size") < LEADERS))
    others = leads.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / tile).cast("long") - 1)))
    cols = ["block", "piece", "sig", "a", "b", "body", F.col("sig").alias("label")]
    tiles = cut.select(*cols, F.lit(0).alias("side")).unionByName(others.select(*cols, F.lit(0).alias("side"))).dropDuplicates(["block", "piece", "sig"])
    links = ws.write(tiles.groupBy("block", "piece").applyInArrow(joiner(percent), "u string, v string"), "links-1")

    big = cut.filter(F.col("size") > tile)
    if not big.limit(1).isEmpty():
        part = components(links, ws, "part", links.count())
        named = ws.write(big.join(part.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig")), "named", NODE_ROWS * found)
        main = named.groupBy("block", "label").count().groupBy("block").agg(F.max(F.struct("count", "label"))["label"].alias("main"))
        rest = named.join(main, "block").filter("label <> main").drop("main")
        left = rest.groupBy("block").agg(F.ceil(F.count("*") / tile).cast("long").alias("lefts"))
        rest = rest.join(left, "block").withColumn("left", F.pmod(at, F.col("lefts")))
        many = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / tile).cast("long") - 1)
        cols = ["block", "left", "piece", "sig", "a", "b", "body", "label"]
        tiles = rest.withColumn("piece", F.explode(many)).select(*cols, F.lit(0).alias("side")).unionByName(
            named.join(left, "block").withColumn("left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1))).select(*cols, F.lit(1).alias("side"))
        )
        more = ws.write(tiles.groupBy("block", "left", "piece").applyInArrow(joiner(percent), "u string, v string"), "links-2")
        links = links.unionByName(more)
    label = components(links, ws, "final", links.count())

    by_set = sets.select("doc_id", "n_shingles", "sig")
    own = by_set.groupBy("sig").agg(F.min("doc_id").alias("_id"))  # of all copies, before they meet their component
    named = own.filter(F.col("sig").isNotNull()).join(label.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    ids = named.groupBy("label").agg(F.min("_id").alias("component_id"))
    of = named.select("sig", "label").join(ids, "label").select("sig", "component_id")
    out = by_set.join(of, "sig", "left").select("doc_id", "n_shingles", F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = ws.write(out, "result")
    ws.drop("sets", "nodes", "blocked", "named", "links-1", "links-2", "block-a", "block-b", "part", "final")
    return out


def keep_one(documents: DataFrame, ws: Workspace, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, that with the smallest id (and text hash, if an id stands twice), with all its columns."""
    key = "_key"
    while key in documents.columns:
        key += "_"
    marked = documents.withColumn(key, F.struct(F.col(doc_id).alias("i"), F.xxhash64(text).alias("h")))
    found = link(marked, ws, key, text, **options)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    twice = ws.write(found.filter("doc_id <=> component_id").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(key)), "twice")
    kept = marked.join(gone, marked[key].eqNullSafe(gone[key]), "left_anti")
    if not twice.isEmpty():  # rows that repeat an id with its text
        once = kept.join(twice, kept[key].eqNullSafe(twice[key]), "left_semi").dropDuplicates([key])
        kept = kept.join(twice, kept[key].eqNullSafe(twice[key]), "left_anti").unionByName(once)
    return kept.drop(key)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), Workspace(spark, "op4"))


#: DuckDB: all pairs that share a shingle, and the transitive closure of their links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, to_id) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.to_id = links.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT id, min(to_id) AS component_id FROM reach GROUP BY id) m ON m.id = w.doc_id
"""
