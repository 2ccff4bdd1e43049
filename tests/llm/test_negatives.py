"""Hard negatives against a plain version of the contract."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.llm import negatives
from sigmill.llm.workspace import Workspace

MOVED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def plain(rows, every):
    some = []
    for n, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        some.append((n, i, label, [math.floor(256 * float(x)) for x in v]))
    out = []
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for n, i, label, v in some:
        if i is None or i % every:
            continue
        scores = [(sum(a * b for a, b in zip(v, w)), j, own) for m, j, own, w in some if m != n]
        for ps, j, _ in sorted((x for x in scores if x[2] == label), key=order)[:5]:
            fit = sorted((x for x in scores if x[2] != label and 30 * ps <= 100 * x[0] <= 90 * ps), key=order)[:10]
            out += [(i, j, k + 1, y, ps, ns) for k, (ns, y, _) in enumerate(fit)]
    return out


def mined(spark, rows, every=10, **options):
    df = spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id long, embedding array<float>, label int")
    df = df.withColumns({"row": F.lit("x"), "cell": F.lit(1), "id": F.lit(2), "size": F.lit(3), "rank": F.lit(4)})
    return negatives.mine(df.repartition(3), Workspace(spark, "t11"), f"id % {every} = 0", label=MOVED, **options)


key = lambda x: tuple((y is None, y or 0) for y in x)


def clustered(seed, n, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dims))
    return [(int(k), (centres[k % 7] + 0.3 * rng.normal(size=dims)).tolist(), int(rng.integers(0, 4))) for k in rng.permutation(n)]


@pytest.mark.parametrize("options", [{}, {"cell_anchors": 3, "tile_rows": 20}, {"cell_anchors": 1, "tile_rows": 7, "pivots": 9}])
def test_against_all_scores(spark, options):
    rows = clustered(3, 260)
    copy = rows[5][1]
    rows += [(1000 + k, copy, k % 3) for k in range(70)]  # many copies of one vector, under several labels
    rows += [(None, rows[0][1], rows[0][2]), (None, copy, 1), (2000, None, 1), (2010, [1.0] * 6, None), (2020, [float("nan")] * 6, 1), (2030, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2040, [float("inf")] + [0.0] * 5, 1)]
    rows += [(2050, [0.0] * 6, 2), (2060, [], 2), (2070, [3.0, -1.0], 1), (2080, [1.0] * 6, 9), rows[0], rows[1]]  # lone label, repeated rows
    got = mined(spark, rows, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain([(i, np.float32(v).tolist() if v is not None and None not in v else v, x) for i, v, x in rows], 10), key=key)


def test_rows_are_sent_only_where_they_might_serve(spark):
    """Far clusters aren't compared: fewer rows than rows times cells."""
    rng = np.random.default_rng(1)
    v = np.repeat(np.eye(8) * 20, 60, 0) + rng.normal(size=(480, 8))
    size = (np.floor(v * 256).astype(np.int64) ** 2).sum(1)
    space = negatives.Space(8, int(size.max()), np.floor(v * 256).astype(np.int64), size, 8)
    rows = [(k, np.floor(x * 256).astype(int).tolist(), int(s), k // 60) for k, (x, s) in enumerate(zip(v, size))]
    df = spark.createDataFrame(rows, "row long, v array<int>, size long, label string").withColumn("id", F.col("row"))
    placed = space.assign(df)
    off = {r.home: r.off for r in placed.groupBy("home").agg(F.max("off").alias("off")).collect()}
    cells = sorted(off)
    column = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")
    asked = placed.withColumns({"cells": column(cells, "int"), "near": column([0.0] * len(cells), "double"), "far": column([1500.0] * len(cells), "double"), "off_most": column([off[c] for c in cells], "double")})
    assert space.sent(placed, [1] * 8, True).count() == 480
    far = asked.withColumn("far", column([float("inf")] * len(cells), "double"))
    assert space.sent(asked, [1] * 8, False).count() < 0.5 * space.sent(far, [1] * 8, False).count()


def test_huge_components_and_empty_tables(spark):
    big = 2.0**17
    rows = [(k * 10, [big * (k + 1), -big], k % 2) for k in range(4)] + [(50, [1e30, 0.0], 1), (60, [-big, 1.0], 0)]
    rows += [(70 + k, [100.0 + k, 3.0], k % 2) for k in range(9)]
    assert sorted(map(tuple, mined(spark, rows).collect()), key=key) == sorted(plain([x for x in rows if x[0] != 50], 10), key=key)
    assert mined(spark, rows).filter("anchor_id = 50 OR negative_id = 50").count() == 0
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]).count() == 0
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(df, Workspace(spark, "t11"), "id % 10 = 0").count() == 0


def test_first_takes_ties_by_id():
    rng = random.Random(2)
    for n in (0, 1, 5, 40):
        score = np.array([rng.randint(0, 3) for _ in range(n)], np.int64)
        ids = np.array([rng.randint(0, 9) for _ in range(n)], np.int64)
        lost = np.array([rng.random() < 0.2 for _ in range(n)], bool)
        want = sorted(range(n), key=lambda k: (-score[k], lost[k], ids[k], k))[:4]
        assert negatives.first(score, ids, lost, np.arange(n), 4).tolist() == want
