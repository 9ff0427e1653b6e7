"""Adapters from the driver's test tables to the shapes the operators take.

The reference reads a scored web corpus, a micro-batch log and chat data; the test
tables stand in for them with these fixed mappings (the DuckDB twin uses the same):

* corpus: ``documents`` with ``score = cast(doc_id * 37 % 101 AS DOUBLE) / 100``
  (spans 0.00..1.00 and hits 0.60, 0.75 and 1.00 exactly), ``__index__`` = doc_id.
* micro-batch log: ``events`` with ``batch_idx = event_id``, ``loss = value``,
  ``rank = 0``, ``epoch = 0``.
* chat: ``conversations`` as is.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fixture_score(doc_id) -> "F.Column":
    return (F.col(doc_id) * 37 % 101).cast("double") / F.lit(100.0)


def corpus_from_documents(docs: DataFrame) -> DataFrame:
    """``documents`` -> corpus ``(doc_id, text, score, __index__, source, lang)``."""
    return docs.select(
        "doc_id", "text",
        fixture_score("doc_id").alias("score"),
        F.col("doc_id").cast("string").alias("__index__"),
        "source", "lang",
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_documents(table(spark, sf_dir, "documents"))


def micro_log_from_events(events: DataFrame) -> DataFrame:
    """``events`` -> micro-batch log ``(epoch, rank, batch_idx, ts, loss)``."""
    return events.select(
        F.lit(0).alias("epoch"), F.lit(0).alias("rank"),
        F.col("event_id").alias("batch_idx"), "ts", F.col("value").alias("loss"),
    )


def micro_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return micro_log_from_events(table(spark, sf_dir, "events"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
