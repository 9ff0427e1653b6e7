"""Registered queries: Structured Streaming runs (file source, ``availableNow``,
Parquet file sink with its own checkpoint) read back as tables, so the streaming
paths go through the same DuckDB twins as their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill.queries.block_queries import L, MIN_LEN, STRIDE
from tokenmill.queries.sql_common import CLASSIFIED, CORPUS, blocks_cte, csv, token_ids
from tokenmill.registry import register
from tokenmill.schemas import BLOCKS
from tokenmill.session import scratch_path
from tokenmill.streaming import streams

G = 8


@register("streamed_blocks", sql=f"""
WITH {CORPUS}, {CLASSIFIED}, tok AS (SELECT doc_id, {token_ids()} AS ids FROM classified
  WHERE bucket = 'score_0.75_to_1.0'), {blocks_cte('tok', L, STRIDE, MIN_LEN)}
SELECT doc_id, chunk_idx, {csv('input_ids')} AS input_ids, {csv('attention_mask')} AS attention_mask FROM blocks""")
def streamed_blocks(spark, sf_dir):
    """T1-T3 on a file stream: high-band documents -> blocks, appended exactly once."""
    out = scratch_path(spark, "stream-blocks")
    q = streams.stream_blocks(spark, sf_dir, out, glob="documents.parquet", length=L, stride=STRIDE, min_len=MIN_LEN,
                              checkpoint=scratch_path(spark, "stream-blocks-ckpt"))
    streams.run_to_end(q)
    got = spark.read.schema(BLOCKS).parquet(out)  # no block at all leaves no file to take it from
    return got.select("doc_id", "chunk_idx", F.array_join("input_ids", ",").alias("input_ids"),
                      F.array_join("attention_mask", ",").alias("attention_mask"))


@register("streamed_step_loss", sql=f"""
WITH log AS (SELECT 0 AS epoch, 0 AS rank, event_id AS batch_idx, ts, value AS loss FROM events)
SELECT epoch, rank, batch_idx // {G} AS opt_step, round(sum(loss / {G}), 6) AS loss, count(*) AS micro_batches
FROM log GROUP BY epoch, rank, opt_step
HAVING bool_or(batch_idx % {G} = {G - 1})""")
def streamed_step_loss(spark, sf_dir):
    """G4 on a streaming log: per-step state; at the end of the input the closed steps that
    are still open are added."""
    out = scratch_path(spark, "stream-steps")
    checkpoint = scratch_path(spark, "stream-steps-ckpt")
    log = streams.micro_log_stream(spark, sf_dir, glob="events.parquet")
    result = streams.stream_step_loss(log, grad_accum=G)
    q = (result.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(out))
    streams.run_to_end(q)
    got = spark.read.schema(streams.STEP_OUT).parquet(out).unionByName(streams.open_closed_steps(spark, checkpoint))
    return got.select("epoch", "rank", "opt_step", F.round("loss", 6).alias("loss"), "micro_batches")
