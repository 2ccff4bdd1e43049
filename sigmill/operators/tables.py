"""The table library: filters, unions, averages and checks of performance tables, and operations on pairs of data sets.

Parameter columns start with two underscores. Sets of data sets are small by nature; their rows aren't, so pairs of sets
are made of set names first and meet the rows by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigmill.functions.expr import correlation


def strip(df: DataFrame, keep: dict[str, list], columns: list[str] | None = None, invert: bool = False) -> DataFrame:
    """Rows whose columns hold one of the values (or, inverted, none of them), projected."""
    if any(c not in df.columns for c in keep):
        return df.limit(0)
    ok = reduce(lambda a, b: a & b, [~F.col(c).isin(v) if invert else F.col(c).isin(v) for c, v in keep.items()], F.lit(True))
    out = df.filter(ok)
    return out.select(*columns) if columns else out


def merge_common(*tables: DataFrame) -> DataFrame:
    """All rows, with the columns that all tables have."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
    return reduce(DataFrame.unionByName, [t.select(*common) for t in tables])


def extend(*tables: DataFrame) -> DataFrame:
    """All rows and all columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def add_key(df: DataFrame, name: str, value) -> DataFrame:
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    return df.withColumn(name, F.lit(value))


def average_rows(df: DataFrame, averaged: list[str], metrics: list[str]) -> DataFrame:
    """Means over rows that agree in all parameters but the averaged ones, which read "averaged"."""
    keys = [c for c in df.columns if c.startswith("__") and c not in averaged]
    out = df.groupBy(*keys).agg(*(F.avg(m).alias(m) for m in metrics))
    return out.withColumns({c: F.lit("averaged") for c in averaged})


def seen_settings(df: DataFrame, columns: list[str], constraint: str | None = None, most: int = 10_000) -> DataFrame:
    """The parameter space of what a table holds: every combination of the values seen in its columns (null is none), less
    those that the constraint excludes. A column with more than ``most`` values isn't a parameter, and is an error."""
    n = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    if many := [c for c in columns if n[c] > most]:
        raise ValueError(f"too many values for parameters: {many}")
    space = df.sparkSession.range(1)
    for c in columns:
        space = space.crossJoin(df.filter(F.col(c).isNotNull()).select(c).distinct())  # values of parameters, whose number was checked
    space = space.drop("id")
    return space if constraint is None else space.filter(constraint)


def expected_settings(values: dict[str, list], spark: SparkSession, constraint: str | None = None) -> DataFrame:
    """The parameter space: every combination of values, less those that the constraint (an SQL expression) excludes.

    Its size is that of the experiment's plan, given by the caller, and no table's.
    """
    space = spark.range(1)
    for k, v in values.items():
        whole = isinstance(v[0], int) and not isinstance(v[0], bool)
        space = space.withColumn(k, F.explode(F.array(*(F.lit(x).cast("long") if whole else F.lit(x) for x in v))))
    space = space.drop("id")
    return space.filter(constraint) if constraint else space


def missing(expected: DataFrame, results: DataFrame, keys: list[str], splits: int) -> DataFrame:
    """Expected settings whose number of result rows isn't splits."""
    seen = results.groupBy(*keys).agg(F.count("*").alias("found"))
    return expected.join(seen, keys, "left").withColumn("found", F.coalesce("found", F.lit(0).cast("long"))).filter(F.col("found") != splits)


def complete(results: DataFrame, expected: DataFrame, keys: list[str], splits: int, defaults: dict) -> DataFrame:
    """Results with the rows that are missing, filled with defaults."""
    gaps = missing(expected, results, keys, splits).filter(F.col("found") < splits).withColumn("_n", F.explode(F.sequence(F.lit(1), (F.lit(splits) - F.col("found")).cast("int"))))
    return results.unionByName(gaps.select(*keys, *(F.lit(v).alias(k) for k, v in defaults.items())), allowMissingColumns=True)


def cube(df: DataFrame, parameters: list[str], metric: str) -> DataFrame:
    """Mean and number for every subset of fixed parameters; a free one is null."""
    return df.cube(*parameters).agg(F.avg(metric).alias("mean"), F.count("*").alias("n"))


def reduce_table(df: DataFrame, parameter: str, related: list[str], metric: str) -> DataFrame:
    return df.groupBy(parameter, *related).agg(F.avg(metric).alias(metric))


def variable_parameters(df: DataFrame, columns: list[str], numeric_from: int = 5) -> DataFrame:
    """column, number of values, and whether it counts as numeric: castable values only, and numeric_from of them or more."""
    long = df.select(*(F.col(c).cast("string").alias(c) for c in columns)).unpivot([], columns, "column", "v")
    per = long.groupBy("column", "v").agg(F.count("*").alias("_n"))  # a row for each value: distinct counts without one hot group
    out = per.groupBy("column").agg(F.count("v").alias("n_values"), F.min(F.expr("try_cast(v AS double) IS NOT NULL").cast("int")).alias("_num"))
    return out.select("column", "n_values", ((F.col("_num") == 1) & (F.col("n_values") >= numeric_from)).alias("is_numeric"))


def split_name(df: DataFrame, column: str, fields: list[str], separator: str) -> DataFrame:
    """Parameters out of a structured name."""
    parts = F.split(column, separator)
    return df.withColumns({f"__{n}": F.get(parts, k) for k, n in enumerate(fields)})


def all_vs_one(sets: DataFrame, rows: DataFrame, name: str, constraint: Column | None = None, reverse: bool = False) -> DataFrame:
    """For each set: its own rows as one side ("test"), those of all others that the constraint allows as the other."""
    a, b = sets.alias("a"), sets.alias("b")
    pairs = a.crossJoin(b).select(F.col(f"a.{name}").alias("target"), F.col(f"b.{name}").alias(name)).filter(F.col("target") != F.col(name) if constraint is None else (F.col("target") != F.col(name)) & constraint)
    own = sets.select(F.col(name).alias("target"), F.col(name))
    test, train = ("train", "test") if reverse else ("test", "train")
    plan = pairs.withColumn("side", F.lit(train)).unionByName(own.withColumn("side", F.lit(test)))
    return plan.join(rows, name)


def pairs_of_sets(sets: DataFrame, name: str, same: bool = False) -> DataFrame:
    """Ordered pairs (train, test) of set names."""
    out = sets.select(F.col(name).alias("train")).crossJoin(sets.select(F.col(name).alias("test")))
    return out if same else out.filter("train <> test")


def concatenate(rows: DataFrame, name: str, time: str, end: str) -> DataFrame:
    """All sets one after the other in time: each starts where the sets before it (by name) have ended."""
    ends = rows.groupBy(name).agg(F.max(end).alias("_end"))
    before = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)  # one row for each set
    shift = ends.withColumn("_shift", F.coalesce(F.sum("_end").over(before), F.lit(0)))
    return rows.join(F.broadcast(shift), name).withColumn(time, F.col(time) + F.col("_shift")).withColumn(end, F.col(end) + F.col("_shift")).drop("_end", "_shift")


def paired_statistics(df: DataFrame, parameter: str, related: list[str], metric: str, alpha: float = 0.05) -> DataFrame:
    """For each pair of parameter values: paired t statistic, degrees of freedom, correlation, means and corrected levels."""
    per = df.groupBy(parameter, *related).agg(F.avg(metric).alias("v"))
    values = per.select(parameter).distinct()
    a = per.select(F.col(parameter).alias("a"), *related, F.col("v").alias("va"))
    b = per.select(F.col(parameter).alias("b"), *related, F.col("v").alias("vb"))
    pairs = a.join(b, related).filter("a > b").withColumn("diff", F.col("va") - F.col("vb"))
    n = values.agg(F.count("*").alias("n_values"))
    out = pairs.groupBy("a", "b").agg(
        F.count("*").alias("k"), F.avg("diff").alias("mean_diff"), F.stddev_samp("diff").alias("sd_diff"), correlation("va", "vb").alias("correlation"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b")
    )
    t = F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt(F.col("k").cast("double"))))
    return out.crossJoin(F.broadcast(n)).select("a", "b", "k", "mean_diff", "sd_diff", t.alias("t"), (F.col("k") - 1).alias("df"), "correlation", "mean_a", "mean_b", (alpha / F.col("n_values")).alias("bonferroni"), (1 - F.pow(F.lit(1 - alpha), 1 / F.col("n_values"))).alias("sidak"))


def project(df: DataFrame, parameter: str, values: list) -> DataFrame:
    """Rows where a parameter has one of the values. With a single value the parameter's column says nothing more and goes;
    a table without such a value is left as it is."""
    some = df.filter(F.col(parameter).isin(values))
    if some.isEmpty():
        return df
    return some.drop(parameter) if len(values) == 1 else some


def parse_cells(df: DataFrame, column: str, kind: str = "kind", number: str = "number") -> DataFrame:
    """The kind of a column's cells, which are text (integer, float or text), and their value as a number."""
    value = F.col(column).try_cast("double")
    return df.withColumns({kind: F.when(F.col(column).rlike("^[+-]?[0-9]+$"), "int").when(value.isNotNull(), "float").otherwise("str"), number: value})


def numeric(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Metric cells that are text as numbers; empty ones, and others that aren't numbers, as 0."""
    return df.withColumns({m: F.coalesce(F.col(m).try_cast("double"), F.lit(0.0)) for m in metrics})


def indexed(df: DataFrame, by: list[str], order: str, values: list[str]) -> DataFrame:
    """One row for each setting: the last of several by order."""
    return df.groupBy(*by).agg(F.max(F.struct(order, *values)).alias("_r")).select(*by, "_r.*")


def entry(df: DataFrame, **setting) -> DataFrame:
    """The rows of one setting, without its columns."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in setting.items()], F.lit(True))).drop(*setting)


def compressed(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """One row for each combination of parameters: how many results, and mean and deviation of every metric."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))))
