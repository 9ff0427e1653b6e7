"""The corpus pipeline: quality rules, quality classifier, near-dedup, benchmark
decontamination and packing, each by its operator in ``tokenmill.llm``.

A stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``.
The result is one row per packed piece of the documents that are left.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tokenmill.llm import decontaminate, near_dup, packing, quality_classifier, quality_rules
from tokenmill.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules reject go."""
    return quality_rules.keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the threshold go; the model is of the labelled ones that are left."""
    return quality_classifier.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.drop_documents(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_dedup),
          ("decontamination", clean), ("packing", pack)]

#: SQL can't express expectation-maximisation, descent or the packing program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
