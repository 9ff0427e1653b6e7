"""Tokenize documents and cut them into fixed-length, overlapping blocks.

Everything here is narrow: token ids stay inside the row (no explode of tokens, no
vocabulary join), and the sliding window is a closed form over window starts. The
starts are generated and each block is sliced as its own row, so a document of any
length has one block at a time in memory besides its ids. No shuffle, no Python worker.

Window rule (the reference's loop, restated): for ``n`` tokens,
``n <= L`` gives one block ``(0, n)`` whatever ``n`` is, even 0; otherwise windows
start at ``k*stride`` for ``k = 0 .. ceil((n-L)/stride)`` and a window is kept while
``start < n`` and ``min(L, n-start) >= min_len`` (lengths never grow, so the first
short window ends the document).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.arrays import attention_mask, labels_from_ids, pad_right, array_sum
from tokenmill.functions.text import DEFAULT_ID_OFFSET, DEFAULT_ID_SPACE, hashed_token_ids, word_count
from tokenmill.schemas import require_columns

# Fixed values of the reference's chunker.
MAX_LENGTH = 2048
STRIDE = 1024
MIN_CHUNK_LENGTH = 256
# Pad id of our hashed id space (ids start at DEFAULT_ID_OFFSET, so no word hits it).
PAD_ID = 0


def tokenize(df: DataFrame, text: str = "text", out: str = "input_ids",
             id_space: int = DEFAULT_ID_SPACE, offset: int = DEFAULT_ID_OFFSET, hash: str = "md5") -> DataFrame:
    """Add ``out`` = hashed word ids of ``text`` (no truncation, no padding)."""
    require_columns(df, text)
    return df.withColumn(out, hashed_token_ids(text, id_space, offset, hash))


def window_starts(n: Column, length: int, stride: int, min_len: int) -> Column:
    """Start offsets of the kept windows for a sequence of ``n`` tokens."""
    if length <= 0 or stride <= 0:
        raise ValueError("length and stride must be positive")
    last_k = F.greatest(F.lit(0), F.floor((n - F.lit(length) + F.lit(stride - 1)) / F.lit(stride)).cast("int"))
    candidates = F.sequence(F.lit(0), last_k * F.lit(stride), F.lit(stride))
    kept = F.filter(candidates, lambda s: (s < n) & (F.least(F.lit(length), n - s) >= F.lit(min_len)))
    return F.when(n <= F.lit(length), F.array(F.lit(0))).otherwise(kept)


def chunk(df: DataFrame, ids: str = "input_ids", length: int = MAX_LENGTH, stride: int = STRIDE,
          min_len: int = MIN_CHUNK_LENGTH, pad_id: int = PAD_ID,
          keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per block: ``keep`` columns, ``chunk_idx``, ``input_ids``, ``attention_mask``.

    Every other input column is dropped (the reference removes all old columns
    after its 1-to-n map)."""
    require_columns(df, ids, *keep)
    rows = df.select(*keep, F.col(ids).alias("__ids"))
    starts = window_starts(F.size("__ids"), length, stride, min_len)
    placed = rows.select(*keep, "__ids", F.posexplode(starts).alias("chunk_idx", "__start"))
    width = F.least(F.lit(length), F.size("__ids") - F.col("__start"))
    return placed.select(*keep, "chunk_idx",
                         pad_right(F.slice("__ids", F.col("__start") + 1, F.lit(length)), length, pad_id).alias("input_ids"),
                         attention_mask(width, length).alias("attention_mask"))


def block_keys(df: DataFrame, text: str = "text", length: int = MAX_LENGTH, stride: int = STRIDE,
               min_len: int = MIN_CHUNK_LENGTH, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` + ``chunk_idx`` + ``start_pos`` + ``n_real`` of every block, without building
    token arrays (only the word count is needed)."""
    counted = df.select(*keep, word_count(text).cast("int").alias("__n"))
    n = F.col("__n")  # computed once per row, not once per candidate window
    return (counted.select(*keep, n, F.posexplode(window_starts(n, length, stride, min_len))
                           .alias("chunk_idx", "start_pos"))
            .withColumn("n_real", F.least(F.lit(length), n - F.col("start_pos")))
            .drop("__n"))


def build_blocks(df: DataFrame, text: str = "text", length: int = MAX_LENGTH, stride: int = STRIDE,
                 min_len: int = MIN_CHUNK_LENGTH, pad_id: int = PAD_ID,
                 keep: tuple[str, ...] = ("doc_id",), id_space: int = DEFAULT_ID_SPACE,
                 offset: int = DEFAULT_ID_OFFSET, hash: str = "md5") -> DataFrame:
    """Tokenize then chunk, one narrow stage; rows out != rows in."""
    tok = df.select(*keep, hashed_token_ids(text, id_space, offset, hash).alias("__ids"))
    return chunk(tok, "__ids", length, stride, min_len, pad_id, keep)


def as_training_view(df: DataFrame) -> DataFrame:
    """Project to the two columns the trainer reads."""
    require_columns(df, "input_ids", "attention_mask")
    return df.select("input_ids", "attention_mask")


def with_labels(df: DataFrame, pad_id: int = PAD_ID, by: str = "pad") -> DataFrame:
    """Add ``labels``: ``input_ids`` with padding as -100.

    ``by="pad"`` (default, as the reference) replaces every pad-valued id;
    ``by="mask"`` replaces the positions whose attention mask is 0."""
    require_columns(df, "input_ids")
    if by == "pad":
        return df.withColumn("labels", labels_from_ids("input_ids", pad_id))
    if by == "mask":
        return df.withColumn("labels", labels_from_ids("input_ids", pad_id, mask=F.col("attention_mask")))
    raise ValueError("by must be 'pad' or 'mask'")


def padding_report(blocks: DataFrame, group: tuple[str, ...] = (), length: int | None = None) -> DataFrame:
    """Blocks, real tokens, capacity and padding share per group.

    On materialised blocks the real tokens are ``sum(attention_mask)``. On block
    keys (``block_keys``: one ``n_real`` per block, pass the block ``length``) the
    same figures come without building any token array."""
    if "attention_mask" in blocks.columns:
        real = array_sum("attention_mask")
        cap = F.size("attention_mask").cast("bigint")
    elif "n_real" in blocks.columns and length:
        real = F.col("n_real").cast("bigint")
        cap = F.lit(length).cast("bigint")
    else:
        raise ValueError("need attention_mask, or n_real and the block length")
    agg = (blocks.groupBy(*group) if group else blocks.groupBy())
    return (agg.agg(F.count(F.lit(1)).alias("blocks"), F.sum(real).alias("real_tokens"),
                    F.sum(cap).alias("capacity"))
            .withColumn("pad_share", F.round(F.lit(1.0) - F.col("real_tokens") / F.col("capacity"), 6)))
