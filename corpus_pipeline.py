"""A corpus pipeline of five stages over `documents`; each stage's result is written as Parquet and read by the next.

toxicity       drops documents whose toxicity score reaches the threshold
quality        drops documents whose quality score is under the threshold
near_copies    keeps one document of each class of near copies
benchmark      drops documents that overlap a benchmark item
packing        places what is left in bins: a row for each piece of a document

All stages but the last return the columns of documents. A row without a doc_id passes the filters that judge by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textindex_spark.llm import decontamination, jaccard_join, packing, quality_model, toxicity
from textindex_spark.llm.common import materialize, read_table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep(docs, quality_model.fit(docs, read_table(spark, sf_dir, "labels")))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Fitted models are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
