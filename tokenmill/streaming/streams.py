"""Structured Streaming entry points.

The corpus operators (classify, tokenize, chunk, labels, formatting) are
stateless and narrow, so they take a streaming DataFrame unchanged: new corpus
files become new blocks, written exactly once through the sink's checkpoint.

Step loss over a live micro-batch log needs state: a step's micro-batches may
arrive in different triggers. ``stream_step_loss`` keeps the open steps of each span of
``SPAN`` steps in one small state row (``applyInPandasWithState``, folded by vectors,
as a call of Python per step is too slow) and emits a step once all G micro-batches
are in; an event-time timeout (watermark on ``ts``) emits a step whose closing
micro-batch was seen but some earlier ones never came, and drops the rest. When the
input has come to its end, ``open_closed_steps`` reads the closed steps that still wait
for the watermark from the state store, so together the rows follow the batch rule.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tokenmill import inputs
from tokenmill.functions._cols import idiv
from tokenmill.operators import blocks as B
from tokenmill.operators import classify as C
from tokenmill.session import scratch_path
from tokenmill.sources import fs
from tokenmill.sources.corpus import DOCUMENTS


def _file_stream(reader: DataStreamReader, spark: SparkSession, directory: str, glob: str) -> DataFrame:
    """Parquet files named as ``glob`` under ``directory``; where ``glob`` is the name of a
    table kept as a folder of part files, whatever these are called, the files in it."""
    table = os.path.join(directory, glob)
    if not set("*?[{") & set(glob) and fs.is_dir(spark, table):
        return reader.parquet(table)
    return reader.option("pathGlobFilter", glob).parquet(directory)


def corpus_stream(spark: SparkSession, directory: str, glob: str = "*.parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming corpus from Parquet files appearing under ``directory``."""
    reader = spark.readStream.schema(DOCUMENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return inputs.corpus_from_documents(_file_stream(reader, spark, directory, glob))


def stream_blocks(spark: SparkSession, directory: str, out_dir: str, glob: str = "*.parquet",
                  length: int = B.MAX_LENGTH, stride: int = B.STRIDE, min_len: int = B.MIN_CHUNK_LENGTH,
                  checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """High-band documents of a file stream -> blocks, appended to ``out_dir``."""
    docs = corpus_stream(spark, directory, glob)
    high = C.classify(docs).where(F.col("bucket") == C.HIGH_BUCKET)
    blocks = B.build_blocks(high, "text", length, stride, min_len)
    writer = (blocks.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-blocks-ckpt")))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(out_dir)


# Steps that share a state row: one call of Python folds all of their micro-batches.
SPAN = 1024
_NO_TS = -2**63  # a step none of whose micro-batches has a ``ts``

#: The open steps of a span, an array entry each; times in microseconds, ``due`` in milliseconds.
STEP_STATE = T.StructType([
    T.StructField("opt_step", T.ArrayType(T.LongType())),
    T.StructField("loss", T.ArrayType(T.DoubleType())),
    T.StructField("n", T.ArrayType(T.LongType())),
    T.StructField("closed", T.ArrayType(T.BooleanType())),
    T.StructField("start_us", T.ArrayType(T.LongType())),
    T.StructField("end_us", T.ArrayType(T.LongType())),
    T.StructField("due", T.ArrayType(T.LongType())),
])
STEP_OUT = T.StructType([
    T.StructField("epoch", T.IntegerType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("opt_step", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("micro_batches", T.LongType()),
    T.StructField("start_ts", T.TimestampType()),
    T.StructField("end_ts", T.TimestampType()),
])
_FOLD = {"loss": "sum", "n": "sum", "closed": "max", "start_us": "min", "end_us": "max"}


def _fold_rows(pdf: pd.DataFrame, grad_accum: int) -> pd.DataFrame:
    """A row per step of some micro-batches; a null ``batch_idx`` counts to step 0 of its span."""
    rows = pd.DataFrame({
        "opt_step": pdf["opt_step"].fillna(0).astype("int64"), "loss": pdf["loss"].astype("float64") / grad_accum, "n": 1,
        "closed": pdf["batch_idx"] % grad_accum == grad_accum - 1, "start_us": pdf["ts_us"], "end_us": pdf["ts_us"]})
    return rows.groupby("opt_step").agg(_FOLD)


def _step_update(grad_accum: int):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import warnings
        warnings.filterwarnings("ignore", category=FutureWarning)  # pandas concat of empty outputs
        epoch, rank, span = key
        parts = []
        if state.exists:
            old = pd.DataFrame(dict(zip(STEP_STATE.names, state.get))).set_index("opt_step")
            old[["start_us", "end_us"]] = old[["start_us", "end_us"]].where(lambda us: us != _NO_TS)
            parts.append(old)
        new = [] if state.hasTimedOut else [_fold_rows(pdf, grad_accum) for pdf in batches]
        watermark = state.getCurrentWatermarkMs()
        steps = pd.concat([p.drop(columns="due", errors="ignore") for p in parts + new]).groupby(level=0).agg(_FOLD)
        known = parts[0]["due"] if state.exists else pd.Series(dtype="int64")
        touched = steps.index.isin([step for p in new for step in p.index])
        # give up on the missing micro-batches once the watermark passes the step's
        # latest event time: later rows for it would be beyond the allowed lateness
        latest = (steps["end_us"] // 1000).fillna(watermark).clip(lower=watermark) + 1
        steps["due"] = latest.where(touched, known.reindex(steps.index)).astype("int64")
        late = ~touched & (steps["due"] < watermark)
        emitted = (steps["n"] >= grad_accum) | (late & steps["closed"].astype(bool))
        out, left = steps[emitted], steps[~emitted & ~late]
        if len(left):
            us = left[["start_us", "end_us"]].fillna(_NO_TS).astype("int64")
            state.update((left.index.tolist(), left["loss"].tolist(), left["n"].tolist(), left["closed"].astype(bool).tolist(),
                          us["start_us"].tolist(), us["end_us"].tolist(), left["due"].tolist()))
            state.setTimeoutTimestamp(max(int(left["due"].min()), watermark))
        elif state.exists:
            state.remove()
        if len(out):
            yield pd.DataFrame({
                "epoch": epoch, "rank": rank, "opt_step": None if span is None else out.index, "loss": out["loss"].to_numpy(),
                "micro_batches": out["n"].to_numpy(), "start_ts": pd.to_datetime(out["start_us"].to_numpy(), unit="us", utc=True),
                "end_ts": pd.to_datetime(out["end_us"].to_numpy(), unit="us", utc=True)}, index=range(len(out)))

    return update


def stream_step_loss(log: DataFrame, grad_accum: int = 8, watermark: str = "1 hour") -> DataFrame:
    """G4 on a streaming micro-batch log ``(epoch, rank, batch_idx, ts, loss)``."""
    keyed = (log.withColumn("ts", F.col("ts").cast("timestamp"))
             .withColumn("ts_us", F.unix_micros("ts"))
             .withWatermark("ts", watermark)
             .withColumn("opt_step", idiv("batch_idx", grad_accum))
             .withColumn("span", idiv("opt_step", SPAN)))
    return keyed.groupBy("epoch", "rank", "span").applyInPandasWithState(
        _step_update(grad_accum), STEP_OUT, STEP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def micro_log_stream(spark: SparkSession, directory: str, glob: str = "*.parquet") -> DataFrame:
    """Streaming micro-batch log from the ``events`` fixture files."""
    schema = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ])
    return inputs.micro_log_from_events(_file_stream(spark.readStream.schema(schema), spark, directory, glob))


def open_closed_steps(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Steps in a stopped ``stream_step_loss`` run's state whose closing micro-batch was
    seen, as the stream would emit them. Read after the input has ended; a run that is
    resumed from the checkpoint would emit them itself later."""
    state = spark.read.format("statestore").load(checkpoint)
    steps = state.select("key.epoch", "key.rank", "key.span", F.inline(F.arrays_zip(*[f"value.groupState.{c}" for c in STEP_STATE.names])))
    ts = lambda c: F.timestamp_micros(F.nullif(F.col(c), F.lit(_NO_TS).cast("bigint")))
    return steps.where("closed").select(
        "epoch", "rank", F.when(F.col("span").isNotNull(), F.col("opt_step")).alias("opt_step"), "loss",
        F.col("n").alias("micro_batches"), ts("start_us").alias("start_ts"), ts("end_us").alias("end_ts"))


def run_to_end(query: StreamingQuery) -> None:
    """Wait for an ``availableNow`` run, however long it takes; its failure is raised."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
