"""What larger tables bring: large keys, ties of rounding, plans that don't deal rows by few keys."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sigmill.functions.expr import r6, rounded, spread_hash
from sigmill.operators import generators, margins
from sigmill.plans import online_queries, registry
from sigmill.streaming import online


@pytest.mark.parametrize("x", [0, 1, -1, 3_474_702_000, (1 << 32) - 1, 8_999 * 1_000_003, 1 << 62, -(1 << 63)])
def test_hashes_of_large_ids(spark, x):
    row = spark.range(1).select(F.lit(x).cast("long").alias("x")).select(spread_hash("x").alias("h"), (generators.uniform(F.col("x"), 2654435761, 0) * float(1 << 32) - 0.5).alias("u")).first()
    assert row.h == x * 2654435761 % (1 << 32) and row.u == pytest.approx(row.h, abs=1e-3)


def test_rounding_of_halves_is_that_of_sql(spark):
    halves = [s * (k + 0.5) / 1e6 for k in range(0, 2_000_000, 997) for s in (1, -1)]
    halves += [x + e for x in halves[:400] for e in (1e-16, -1e-16)]
    got = [r.x for r in spark.createDataFrame([(n, x) for n, x in enumerate(halves)], "n long, x double").orderBy("n").select(r6("x").alias("x")).collect()]
    con = duckdb.connect()
    assert got == [con.execute("SELECT round(?::DOUBLE, 6) + 0.0", [x]).fetchone()[0] for x in halves]
    assert spark.range(1).select(rounded(F.lit(None), 1).alias("a"), rounded(F.lit("inf"), 1).alias("b")).first() == (None, float("inf"))


def test_online_scores_add_up_in_order():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 40):
        a, b = rng.normal(size=n), rng.normal(size=n)
        want = 0.0
        for v, w in zip(a.tolist(), b.tolist()):
            want += v * w
        assert online.dot(a, b) == want


def test_online_margins_equal_their_sql_at_ties(spark, tmp_path):
    """Steps of bounded size make scores that are exact halves of the last digit."""
    con = duckdb.connect()
    con.execute("CREATE VIEW base AS SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id % 25 IN (16, 19)")
    con.execute(f"COPY base TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute("CREATE VIEW events AS SELECT * FROM base")
    for name in ("online_margins", "online_stream"):
        got = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
        assert got == sorted(con.execute(registry.oracle_sql()[name]).fetchall())


def close_repeats(tmp_path):
    """A connection with events of three users, each six times with keys that follow one another; also as a file."""
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT event_id * 6 + k AS event_id, ts, user_id, event_type, value, props FROM '/root/testdata/sf0.1/events.parquet', (SELECT unnest(range(6)) AS k) WHERE user_id IN (554, 778, 818)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return con


@pytest.mark.parametrize("name", ["online_margins", "online_stream"])
def test_steps_away_from_far_rows_equal_their_sql(spark, tmp_path, name):
    """Rows so far beyond the outer margin that the step away from them is bounded, by a bound without the class's weight."""
    con = close_repeats(tmp_path)
    got = sorted(tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(registry.oracle_sql()[name]).fetchall())


def test_outer_bounds_by_class():
    x, state = np.array([1.0]), np.array([9.0, 0.0])
    for y, weights, want in ((1.0, (1.0, 1.0), 8.5), (1.0, (1.0, 2.0), 8.0), (-1.0, (1.0, 2.0), 8.5)):
        after, _ = online.Margin(0.5, 2.0, weights=(1.0, 3.0), outer_weights=weights).step(y * state, x, y)
        assert after.tolist() == [y * want, y * (want - 9.0)]


@pytest.mark.parametrize("name", [*online_queries.MARGINS, *online_queries.BALLS])
def test_online_scores_equal_their_sql_to_the_last_bit(tmp_path, name):
    """Before rounding, so no digits are left to chance."""
    con = close_repeats(tmp_path)
    rules = online_queries.MARGINS | online_queries.BALLS
    sql = online_queries._margin_sql if name in online_queries.MARGINS else online_queries._ball_sql
    want = con.execute(f"WITH RECURSIVE {online_queries._ROWS}, {sql(name, rules[name])} SELECT user_id, f FROM {name} WHERE n > 0 ORDER BY user_id, n").fetchall()
    rows = con.execute("SELECT user_id, value / 100, (event_id % 10) / 10.0::DOUBLE, event_type = 'purchase' FROM events ORDER BY user_id, event_id").fetchall()
    got = []
    for user in (554, 778, 818):
        own = [r for r in rows if r[0] == user]
        (out,) = online.Run({name: rules[name]}).rows([r[1:3] for r in own], [1.0 if r[3] else -1.0 for r in own])
        got += [(user, f) for (f,) in out]
    assert got == want


@pytest.mark.parametrize(("name", "joins"), [("devariance", 0), ("regression_vectors", 0), ("constant_channel_cleanup", 0), ("laplacian_reference", 1), ("gaussian_norm", 0), ("histogram_norm", 0), ("linear_fit", 2)])
def test_rows_are_not_dealt_by_channel(spark, name, joins):
    """Where no table counts as small, only records are joined by shuffles."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") == joins
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_made_up_windows_are_more_than_one_task(spark):
    df = spark.createDataFrame([(k, "a") for k in range(1000)], "win long, label string").coalesce(1)
    w = generators.windows_for(df, "win", "label", {"a": generators.time_point}, 5, 2)
    tasks = w.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 10_000


def test_distances_from_landmarks_are_the_same_in_little_memory():
    rng = np.random.default_rng(6)
    x, held = rng.normal(size=(10_000, 64)), rng.normal(size=(52, 64))
    tracemalloc.start()
    got = margins.nearest(x, held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6  # the differences of the whole batch are 266 MB, and as much again for their squares
    assert np.array_equal(got[:500], ((x[:500, None] - held[None]) ** 2).sum(2).min(1)) and len(got) == len(x)
    assert len(margins.nearest(x[:0], held)) == 0


def test_spatial_filters_together_are_those_one_by_one():
    rng = np.random.default_rng(7)
    rules = {"plain": online.AdaptiveXdawn(3, 2), "forgetting": online.AdaptiveXdawn(3, 2, 0.99, 0.98, burn_in=20), "ridge": online.AdaptiveXdawn(3, 2, ridge=10.0), "exact": online.AdaptiveXdawn(3, 2, exact=True), "one": online.AdaptiveXdawn(3, 1)}
    xs = [rng.normal(size=12) + 0.5 * (k % 3 == 0) for k in range(1500)]
    ys = [None if k < 2 or k % 7 == 3 else 1.0 if k % 3 == 0 and k > 5 else -1.0 for k in range(1500)]
    one, many = online.Run(rules), online.Run(rules)
    want = [one.step(x, y) for x, y in zip(xs, ys)]
    got = [many.rows(xs[a:b], ys[a:b]) for a, b in ((0, 3), (3, 40), (40, 1500))]
    for j, name in enumerate(rules):
        mine = np.array([o for part in got for o in part[j]])
        theirs = np.array([o[j] for o in want])
        free = np.abs if name == "exact" else np.asarray  # an eigenvector's sign is free
        assert np.allclose(free(mine), free(theirs), rtol=1e-7, atol=1e-9)
        assert np.allclose(np.abs(many.states[name]), np.abs(one.states[name]), rtol=1e-7, atol=1e-9)


def test_recordings_with_gaps_large_and_missing_values(spark, tmp_path):
    """What is read is what was written: no rows for gaps, nothing clipped, nulls stay nulls."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT event_id + CASE WHEN event_id >= 700 THEN 5000 WHEN event_id >= 300 THEN 7 ELSE 0 END AS event_id, user_id, event_type,
        CASE WHEN event_id % 50 = 3 THEN NULL WHEN event_id BETWEEN 400 AND 420 THEN value + 700 WHEN event_id = 500 THEN -123456.7 WHEN event_id = 501 THEN 655.36 ELSE value END AS value
        FROM '/root/testdata/sf0.001/events.parquet' WHERE event_id < 1000""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    for name in ("recording_samples", "recording_markers"):
        out = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))
