"""Column contracts of the public operators, checked on entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

CORPUS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("__index__", T.StringType()),
    T.StructField("source", T.StringType()),
])

BLOCKS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("chunk_idx", T.IntegerType()),
    T.StructField("input_ids", T.ArrayType(T.LongType())),
    T.StructField("attention_mask", T.ArrayType(T.IntegerType())),
])

MICRO_LOG = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("batch_idx", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("loss", T.DoubleType()),
])

CHAT = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ``ValueError`` naming every missing column."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing columns {missing}; have {sorted(have)}")
