"""Every registered query of the core library against its SQL on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from sigmill.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    return f"{round(float(x), 5) + 0.0:.5g}" if isinstance(x, float) or type(x).__name__ in ("float64", "Decimal") else int(x) if type(x).__name__.startswith(("int", "Int")) else str(x)


def rows(df):
    cols = sorted(df.columns)
    out = []
    for r in df[cols].itertuples(index=False):
        out.append(tuple(str(plain(float(v)) if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "float")) else plain(v)) for v in r))
    return cols, sorted(out)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, DATA).toPandas()), rows(duck.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_need_the_corpus_operators():
    for path in Path(__file__).resolve().parents[1].glob("sigmill/**/*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"sigmill[./]llm|import llm|corpus_pipeline", path.read_text())
