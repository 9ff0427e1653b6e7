"""Fine-tune data preparation: chat rendering, cut-off, packing, per-set caps,
hold-out split, evaluation-set selection and weighted interleaving.

The reference passes these as flags to an outside trainer; the semantics here
are our own and stated per function. Ordering is always by a seeded md5 key with
the row key as tie-breaker, the same in every run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.plans.index import dense_index_by_hash

# ChatML layout (the fine-tune runs use a ChatML-style template).
CHATML = {
    "start": "<|im_start|>",
    "end": "<|im_end|>",
    "generation": "<|im_start|>assistant\n",
}


def seeded_key(cols: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def render_chat(turns: DataFrame, add_generation_prompt: bool = False, template: dict | None = None,
                conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """T4: one prompt string per conversation.

    Each turn is rendered to its segment in a narrow projection; only the
    segments are gathered per conversation (sorted by turn), whose concatenation
    is the output cell itself. Turns without a conversation id belong to none: each
    is a prompt of its own, so they never gather in one cell."""
    t = template or CHATML
    seg = F.concat(F.lit(t["start"]), F.coalesce(F.col(role), F.lit("")), F.lit("\n"),
                   F.coalesce(F.col(text), F.lit("")), F.lit(t["end"] + "\n"))
    per_turn = turns.select(conv, F.struct(F.col(turn).alias("t"), seg.alias("s")).alias("seg"))
    rendered = F.array_join(F.transform(F.array_sort(F.collect_list("seg")), lambda x: x["s"]), "")
    gathered = per_turn.where(F.col(conv).isNotNull()).groupBy(conv).agg(
        rendered.alias("prompt"), F.count(F.lit(1)).cast("bigint").alias("turns"))
    alone = per_turn.where(F.col(conv).isNull()).select(conv, F.col("seg.s").alias("prompt"), F.lit(1).cast("bigint").alias("turns"))
    out = gathered.unionByName(alone)
    return out.withColumn("prompt", F.concat("prompt", F.lit(t["generation"]))) if add_generation_prompt else out


def cutoff_tokens(df: DataFrame, length: int, ids: str = "input_ids") -> DataFrame:
    """Truncate token arrays to ``length``."""
    return df.withColumn(ids, F.slice(F.col(ids), 1, length))


def select_sets(df: DataFrame, names: Sequence[str], col: str = "source") -> DataFrame:
    """Rows of the named data sets only."""
    return df.where(F.col(col).isin(list(names)))


def cap_samples(df: DataFrame, n: int, keys: Sequence[str], by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """O2: at most ``n`` rows per data set (``by``): the lowest by seeded key.

    Exact and skew-safe: positions come from the distributed dense index, so a
    data set holding a third of the rows is never gathered into one task."""
    keyed = df.withColumn("__k", seeded_key(keys, seed))
    ranked = dense_index_by_hash(keyed, "__k", keys, by, out="__r", total=None)
    return ranked.where(F.col("__r") < n).drop("__r", "__k")


def train_val_split(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """O3: the ``n`` rows lowest by seeded key get ``split = 'val'``, the rest 'train'.

    Exactly ``n`` rows (all of them if there are fewer), also with repeated or null
    keys: the split follows distributed positions, not a join on the keys."""
    keyed = df.withColumn("__k", seeded_key(keys, seed))
    ranked = dense_index_by_hash(keyed, "__k", keys, out="__r", total=None)
    return ranked.withColumn("split", F.when(F.col("__r") < n, "val").otherwise("train")).drop("__r", "__k")


def interleave(df: DataFrame, probs: dict[str, float], keys: Sequence[str], set_col: str = "source",
               over: bool = True, seed: int = 42) -> DataFrame:
    """Weighted interleave of the data sets named in ``probs`` (deterministic).

    ``over=True`` (oversampling, until the longest set is used up): with ``n_i``
    rows and weight ``p_i``, ``T = max_i ceil(n_i / p_i)``; set ``i`` contributes
    ``m_i = ceil(p_i * T)`` rows, its row ``r`` being its ``(r mod n_i)``-th row
    in seeded order. ``over=False`` stops at the first exhausted set:
    ``T = min_i floor(n_i / p_i)``, ``m_i = min(n_i, ceil(p_i * T))``.
    Output order key ``(r + 0.5) / p_i`` (ties by set order), plus ``pos``.
    """
    if not probs or any(p <= 0 for p in probs.values()):
        raise ValueError("positive weights are needed")
    spark = df.sparkSession
    names = list(probs)
    weights = spark.createDataFrame([(s, float(probs[s]), i) for i, s in enumerate(names)],
                                    f"{set_col} string, __p double, __set_idx int")
    rows = select_sets(df, names, set_col).withColumn("__k", seeded_key(keys, seed))
    ranked = dense_index_by_hash(rows, "__k", keys, [set_col], out="__j", total="__n")

    sizes = rows.groupBy(set_col).agg(F.count(F.lit(1)).alias("__n")).join(weights, set_col)
    need = (F.ceil(F.col("__n") / F.col("__p")) if over else F.floor(F.col("__n") / F.col("__p")))
    whole = Window.partitionBy()
    t_all = F.max(need).over(whole) if over else F.min(need).over(whole)
    m = F.ceil(F.col("__p") * F.col("__T"))
    sizes = (sizes.withColumn("__T", t_all)
             .withColumn("__m", (m if over else F.least(F.col("__n"), m)).cast("bigint")))
    # every set's (index, weight, rows taken) on every set row: one small array
    all_sets = F.collect_list(F.struct(F.col("__set_idx").alias("i"), F.col("__p").alias("p"),
                                       F.col("__m").alias("m"))).over(whole)
    sizes = sizes.withColumn("__all", all_sets).select(set_col, "__p", "__set_idx", "__m", "__all")
    # one row per named set: bounded by the weights given
    joined = ranked.join(F.broadcast(sizes), set_col)
    n_i = F.col("__n")
    reps = F.when(F.col("__j") < F.col("__m"),
                  F.ceil((F.col("__m") - F.col("__j")) / n_i)).otherwise(F.lit(0)).cast("int")
    out = (joined.withColumn("__t", F.explode(F.sequence(F.lit(0), reps - 1)))
           .where(reps > 0)
           .withColumn("r", (F.col("__j") + F.col("__t") * n_i).cast("bigint"))
           .withColumn("order_key", (F.col("r") + F.lit(0.5)) / F.col("__p")))
    ahead = F.aggregate(F.col("__all"), F.lit(0).cast("bigint"),
                        lambda acc, st: acc + _rows_ahead(st, F.col("order_key"), F.col("__set_idx")))
    out = out.withColumn("pos", F.col("r") + ahead)
    return out.drop("__t", "__k", "__j", "__m", "__p", "__n", "__all")


def _rows_ahead(st: Column, x: Column, own: Column) -> Column:
    """How many rows of set ``st`` come before key ``x`` of set ``own`` in the
    interleave order: keys ``(c + 0.5) / p`` for ``c < m`` are increasing in ``c``,
    so it is the first ``c`` not ahead; ``ceil(x*p - 0.5)`` lands on it or one off,
    and one exact comparison of the same double keys settles it (ties: lower set first)."""
    p, m = st["p"], st["m"]

    def ahead(c):
        key = (c.cast("double") + F.lit(0.5)) / p
        return F.when(st["i"] < own, key <= x).otherwise(key < x)

    c0 = F.least(F.greatest(F.ceil(x * p - F.lit(0.5)), F.lit(0).cast("bigint")), m)
    c = (F.when((c0 > 0) & ~ahead(c0 - 1), c0 - 1)
         .when((c0 < m) & ahead(c0), c0 + 1)
         .otherwise(c0))
    return F.when(st["i"] == own, F.lit(0).cast("bigint")).otherwise(c.cast("bigint"))


# ---- packing (T5) -------------------------------------------------------------------

def _next_fit(batches: Iterator[pd.DataFrame], capacity: int, length_col: str) -> Iterator[pd.DataFrame]:
    """Streaming next-fit over rows sorted by (shard, order); state carries across
    Arrow batches, so memory stays one batch whatever the shard size."""
    shard, bin_id, fill = None, -1, 0
    for pdf in batches:
        if pdf.empty:
            continue
        bins, offs = [], []
        for s, length in zip(pdf["shard"].tolist(), pdf[length_col].tolist()):
            if s != shard:
                shard, bin_id, fill = s, 0, 0
                fresh = True
            else:
                fresh = False
            if length > capacity:
                raise ValueError("a sample is longer than the bin capacity; apply cutoff first")
            if not fresh and fill + length > capacity:
                bin_id, fill = bin_id + 1, 0
            bins.append(bin_id)
            offs.append(fill)
            fill += length
        yield pdf.assign(bin=pd.Series(bins, dtype="int64").values,
                         bin_offset=pd.Series(offs, dtype="int64").values)


def shard_of(keys: Sequence[str], seed: int, n_shards: int) -> Column:
    """Shard from the first 32 bits of the seeded md5 key."""
    h = F.conv(F.substring(seeded_key(keys, seed), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n_shards).cast("bigint")).cast("int")


def pack(df: DataFrame, capacity: int, keys: Sequence[str], length: str = "length", n_shards: int = 1024,
         seed: int = 42) -> DataFrame:
    """T5: next-fit packing of samples into bins of ``capacity`` tokens.

    Samples are spread over ``n_shards`` shards by seeded hash and taken in seeded
    order inside each shard; a sample longer than ``capacity`` must be cut first
    (``cutoff_tokens``) and a sample is never split. The shard count is part of the
    result (next-fit is order-dependent) and bounds the rows one sequential scan
    sees; the task count is the session's: shards are hash-partitioned (whole
    shards per partition, several per partition), sorted, and streamed. Every row of
    ``df`` comes out once with its columns, whatever keys repeat or are null; rows equal
    in keys and length are interchangeable. A shard is one sequential scan of about
    ``rows / n_shards`` numbers and lengths (some 20 bytes each), so take a million rows
    a shard: 1,024 shards for 10^9 samples."""
    keyed = (df.withColumn("shard", shard_of(keys, seed, n_shards))
             .withColumn("__k", seeded_key(keys, seed)))
    order = Window.partitionBy("shard").orderBy("__k", *keys, length)
    numbered = keyed.withColumn("__n", F.row_number().over(order))
    bare = set(df.columns) <= {*keys, length}  # else only numbers and lengths go through Python
    rows = (numbered.drop("__k") if bare else numbered.select("shard", "__n", length)).sortWithinPartitions("shard", "__n")
    schema = T.StructType(list(rows.schema.fields) + [T.StructField("bin", T.LongType()), T.StructField("bin_offset", T.LongType())])
    packed = rows.mapInPandas(lambda it: _next_fit(it, capacity, length), schema)
    if not bare:
        packed = numbered.drop("__k").join(packed.drop(length), ["shard", "__n"])
    return packed.select(*df.columns, "shard", "bin", "bin_offset")
