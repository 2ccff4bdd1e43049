"""The corpus pipeline: documents in, packed training sequences out.

Quality rules, language identification, one document of each near-duplicate group, benchmark decontamination, packing.
Each stage takes (spark, docs, sf_dir); all but the last return documents with the columns they came with.

Defined results: null and empty texts fail the quality rules and go; repeated rows are copies, of which one stays (that
with the smallest id; a row without an id stays only if its copies have none); an empty documents table gives an empty
result, an empty benchmark takes nothing away; other columns, whatever their names, stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigmill.llm import decontaminate, jaccard, languages, packing, quality
from sigmill.llm.workspace import Workspace, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return quality.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the filters learn from the labelled documents outside the held-out fold."""
    return languages.keep(docs, languages.train(docs.filter(~languages.fold())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram Jaccard join links."""
    return jaccard.keep_one(docs, Workspace(spark, "near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the packed sequences."""
    return packing.pack(docs, Workspace(spark, "pack"))


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn, hash and tokenise in ways that SQL can't express; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each stage's result is written and read again, so no stage runs twice."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.write(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            ws.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
