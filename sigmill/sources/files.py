"""Readers of recording and feature files, and the result table's writer.

Fixed-length records are read in splits by Spark, whatever store the path names; headers are small text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_features(spark: SparkSession, path: str, names: list[str] | None = None, label_first: bool = True) -> DataFrame:
    """label and features array from a headerless CSV with the label in the first (or last) column."""
    df = spark.read.csv(path, inferSchema=False)
    cols = df.columns
    label, rest = (cols[0], cols[1:]) if label_first else (cols[-1], cols[:-1])
    out = df.select(F.trim(label).alias("label"), F.array(*(F.expr(f"try_cast(trim(`{c}`) AS double)") for c in rest)).alias("features"))
    return out.withColumn("names", F.array(*map(F.lit, names))) if names else out


def arff(spark: SparkSession, path: str) -> DataFrame:
    """The data section of an ARFF file with the columns that its header declares (numeric ones as double)."""
    lines = spark.read.text(path).withColumn("value", F.trim("value"))
    head = [r["value"] for r in lines.filter(F.lower("value").startswith("@attribute")).collect()]  # one line for each column
    fields = []
    for line in head:
        m = re.match(r"(?i)@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", line)
        fields.append((m[1].strip("'\""), m[2].strip().lower() in ("numeric", "real", "integer")))
    rows = lines.filter((F.col("value") != "") & ~F.col("value").startswith("%") & ~F.col("value").startswith("@"))
    parsed = rows.select(F.from_csv("value", ", ".join(f"`{n}` string" for n, _ in fields), {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "quote": "'"}).alias("r"))
    return parsed.select(*(F.expr(f"try_cast(r.`{n}` AS double)").alias(n) if numeric else F.col(f"r.`{n}`").alias(n) for n, numeric in fields))


def ini_sections(text: str) -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for line in text.splitlines():
        line = line.strip()
        if m := re.fullmatch(r"\[(.+)\]", line):
            own = out.setdefault(m[1], {})
        elif "=" in line and not line.startswith(";") and out:
            k, v = line.split("=", 1)
            own[k.strip()] = v.strip()
    return out


def _text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def brain_products(spark: SparkSession, header: str) -> tuple[DataFrame, DataFrame, float]:
    """samples(t, channel, value), markers(t, marker) and the sampling rate of a .vhdr recording (multiplexed INT_16 or float).

    Each binary record is one time point of all channels, so the signal file is read in splits.
    """
    info = ini_sections(_text(spark, header))
    common = info["Common Infos"]
    names, gain = zip(*((v.split(",")[0], float(v.split(",")[2] or 1)) for _, v in sorted(info["Channel Infos"].items(), key=lambda x: int(x[0][2:]))))
    kind = {"INT_16": "<i2", "IEEE_FLOAT_32": "<f4"}[info["Binary Infos"]["BinaryFormat"]]
    folder = header.rsplit("/", 1)[0]
    width = np.dtype(kind).itemsize * len(names)
    raw = spark.sparkContext.binaryRecords(f"{folder}/{common['DataFile']}", width).zipWithIndex().toDF(T.StructType().add("record", T.BinaryType()).add("t", T.LongType()))

    def decode(batches):
        for b in batches:
            number = np.frombuffer(b"".join(b["record"]), kind).reshape(len(b), -1).astype(float)
            out = pd.DataFrame({"t": np.repeat(b["t"].to_numpy(), len(names)), "channel": np.tile(names, len(b)), "value": (number * np.array(gain)).ravel()})
            if "NoSample" in common:
                out.loc[number.ravel() == float(common["NoValue"]), "value"] = None
                out = out[number.ravel() != float(common["NoSample"])]
            yield out

    samples = raw.mapInPandas(decode, "t long, channel string, value double")
    marker_lines = ini_sections(_text(spark, f"{folder}/{common['MarkerFile']}")).get("Marker Infos", {}) if "MarkerFile" in common else {}
    marks = [(int(v.split(",")[2]) - 1, re.sub(r"\s+", " ", v.split(",")[1]).strip()) for v in marker_lines.values()]
    return samples, spark.createDataFrame([m for m in marks if m[1]], "t long, marker string"), 1e6 / float(common["SamplingInterval"])


def results(df: DataFrame, path: str) -> None:
    """Writes a performance table: parameter columns first, quoted, with a header; one file for each task."""
    first = sorted(df.columns, key=lambda c: (not c.startswith("__"), c))
    df.select(*first).write.csv(path, header=True, quoteAll=True)


def read_results(spark: SparkSession, path: str, metrics: list[str] = ()) -> DataFrame:
    """A performance table; metric columns as numbers, empty ones as 0."""
    df = spark.read.csv(path, header=True)
    return df.withColumns({m: F.coalesce(F.expr(f"try_cast(`{m}` AS double)"), F.lit(0.0)) for m in metrics})


def stored(spark: SparkSession, df: DataFrame, path: str, by: list[str], order: list[str] | None = None) -> DataFrame:
    """Writes records in folders by the columns ``by`` (and, given an order, in ranges of it, each file in order), and reads
    them again with the columns and types they had."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    (out.write.partitionBy(*by) if by else out.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def read_many_results(spark: SparkSession, parts: dict[str, dict]) -> DataFrame:
    """Result tables of several runs as one: all columns that any has, and for each part the parameters given for it."""
    out = None
    for path, parameters in parts.items():
        own = spark.read.option("header", True).csv(path).withColumns({k: F.lit(v) for k, v in parameters.items()})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def merge_traces(spark: SparkSession, path: str, schema: str, fields: list[str] = (), separator: str = "_") -> DataFrame:
    """The traces of all splits and runs below a path as one table: the rows of JSON files below ``trace_sp<fold>``, with
    __run and __fold from ``persistency_run<run>`` and ``trace_sp<fold>`` in their paths, and a parameter for each of fields
    from the data set's folder above the run's, whose name they make up between separators.

    Traces are many small files; Spark packs them into tasks by size, and the parameters come from each row's path, so no
    list of files is gone through one by one. Long traces (``long_trace_sp<fold>``) are a table of their own, by schema."""
    raw = spark.read.schema(schema).option("recursiveFileLookup", "true").json(path)
    at = F.col("_metadata.file_path")
    number = lambda pattern: F.try_to_number(F.nullif(F.regexp_extract(at, pattern, 1), F.lit("")), F.lit("999999999")).cast("long")
    own = raw.withColumns({"__run": number(r"/persistency_run(\d+)/"), "__fold": number(r"/trace_sp(\d+)[^/]*(?:/[^/]*)?$"), "__dataset": F.url_decode(F.regexp_extract(at, r"/([^/]+)/persistency_run\d+/", 1))})
    parts = F.split("__dataset", separator)
    return own.filter(F.col("__run").isNotNull() & F.col("__fold").isNotNull()).withColumns({f"__{n}": F.get(parts, k) for k, n in enumerate(fields)})
