"""All queries of the core library, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigmill.plans import choice_queries, decision_queries, feature_queries, further_queries, learn_queries, machine_queries, metric_queries, model_queries, online_queries, recording_queries, search_queries, signal_queries, source_queries, stream_queries, table_queries, windowed_queries  # noqa: F401  they register themselves
from sigmill.plans.query import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_chain"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
