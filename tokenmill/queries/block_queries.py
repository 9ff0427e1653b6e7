"""Registered queries: tokenize, sliding-window blocks, training view, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.operators import blocks as B
from tokenmill.operators import classify as C
from tokenmill.queries.sql_common import CLASSIFIED, CORPUS, blocks_cte, csv, token_ids
from tokenmill.registry import register

# Small window so the test documents (median ~240 words) really get cut.
L, STRIDE, MIN_LEN = 256, 128, 32


def high_blocks(spark, sf_dir, length=L, stride=STRIDE, min_len=MIN_LEN) -> DataFrame:
    """Flagship: corpus -> high band -> tokenize -> blocks (one narrow stage)."""
    high = C.classify(inputs.corpus(spark, sf_dir)).where(F.col("bucket") == C.HIGH_BUCKET)
    return B.build_blocks(high, "text", length, stride, min_len, keep=("doc_id",))


def all_blocks(spark, sf_dir, length=L, stride=STRIDE, min_len=MIN_LEN) -> DataFrame:
    return B.build_blocks(inputs.table(spark, sf_dir, "documents"), "text", length, stride, min_len)


_TOK = f"tok AS (SELECT doc_id, {token_ids()} AS ids FROM documents)"
_HIGH_TOK = (f"{CORPUS}, {CLASSIFIED}, tok AS (SELECT doc_id, {token_ids()} AS ids FROM classified "
             "WHERE bucket = 'score_0.75_to_1.0')")


@register("token_ids", sql=f"""
WITH {_TOK}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, {csv('ids')} AS ids_csv FROM tok""")
def token_ids_q(spark, sf_dir):
    """T1(a): hashed word ids per document, whole text."""
    tok = B.tokenize(inputs.table(spark, sf_dir, "documents"), out="ids")
    return tok.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.array_join("ids", ",").alias("ids_csv"))


@register("token_windows", sql=f"""
WITH {_TOK}, {blocks_cte('tok', L, STRIDE, MIN_LEN)}
SELECT doc_id, chunk_idx, CAST(start_pos AS BIGINT) AS start_pos,
       CAST(list_sum(attention_mask) AS BIGINT) AS n_real FROM blocks""")
def token_windows(spark, sf_dir):
    """T2 + F5: window start and real length of every block of every document."""
    keys = B.block_keys(inputs.table(spark, sf_dir, "documents"), "text", L, STRIDE, MIN_LEN)
    return keys.select("doc_id", "chunk_idx", F.col("start_pos").cast("bigint").alias("start_pos"),
                       F.col("n_real").cast("bigint").alias("n_real"))


@register("token_blocks", sql=f"""
WITH {_HIGH_TOK}, {blocks_cte('tok', L, STRIDE, MIN_LEN)}
SELECT doc_id, chunk_idx, {csv('input_ids')} AS input_ids, {csv('attention_mask')} AS attention_mask
FROM blocks""")
def token_blocks(spark, sf_dir):
    """T3 + X5 + X6: high-band documents as padded blocks with attention masks."""
    return high_blocks(spark, sf_dir).select(
        "doc_id", "chunk_idx", F.array_join("input_ids", ",").alias("input_ids"),
        F.array_join("attention_mask", ",").alias("attention_mask"))


@register("training_view", sql=f"""
WITH {_HIGH_TOK}, {blocks_cte('tok', L, STRIDE, MIN_LEN)}
SELECT {csv('input_ids')} AS input_ids, {csv('attention_mask')} AS attention_mask FROM blocks""")
def training_view(spark, sf_dir):
    """only the two columns the trainer reads."""
    v = B.as_training_view(high_blocks(spark, sf_dir))
    return v.select(F.array_join("input_ids", ",").alias("input_ids"),
                    F.array_join("attention_mask", ",").alias("attention_mask"))


@register("training_labels", sql=f"""
WITH {_HIGH_TOK}, {blocks_cte('tok', L, STRIDE, MIN_LEN)}
SELECT doc_id, chunk_idx,
       {csv("list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)")} AS labels
FROM blocks""")
def training_labels(spark, sf_dir):
    """labels = ids with every pad id as -100."""
    lab = B.with_labels(high_blocks(spark, sf_dir), pad_id=B.PAD_ID)
    return lab.select("doc_id", "chunk_idx", F.array_join("labels", ",").alias("labels"))


@register("padding_report", sql=f"""
WITH {_TOK}, {blocks_cte('tok', L, STRIDE, MIN_LEN)}
SELECT count(*) AS blocks, CAST(sum(list_sum(attention_mask)) AS BIGINT) AS real_tokens,
       CAST(sum(len(attention_mask)) AS BIGINT) AS capacity,
       round(1.0::DOUBLE - sum(list_sum(attention_mask))::DOUBLE / sum(len(attention_mask))::DOUBLE, 6) AS pad_share
FROM blocks""")
def padding_report(spark, sf_dir):
    """Real tokens vs capacity over all blocks of all documents (from block keys:
    only window lengths are needed, so no token ids are hashed)."""
    keys = B.block_keys(inputs.table(spark, sf_dir, "documents"), "text", L, STRIDE, MIN_LEN)
    return B.padding_report(keys, length=L)
