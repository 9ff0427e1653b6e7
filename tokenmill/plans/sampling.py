"""The training loader as tables: seeded shuffle, dense index, rank shards,
batches, optimizer steps, multi-epoch plan, resume and checkpoint steps.

Plans carry sample keys only (``doc_id, chunk_idx``), never token arrays, so the
one range exchange of the dense index moves a few dozen bytes per sample.

Our fixed rules (the reference delegates them to its loader library):

* shuffle key of a sample in an epoch: ``md5('<seed>:<epoch>:<key..>')``, ties by key;
* shard: pad by repeating the first ``ceil(n/W)*W - n`` samples of the epoch's
  order, then ``rank = pos % W`` and ``pos_in_rank = pos / W``;
* batch: ``batch_idx = pos_in_rank / B``; the sharded loader keeps the last short
  batch, the single-process loader drops it;
* optimizer step: ``batch_idx / G``; a trailing group of fewer than G batches is
  not a step (``opt_step`` null).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.functions._cols import ceil_div, idiv
from tokenmill.plans.index import dense_index_by_hash

# Fixed values of the reference's trainer.
SEED = 42
GRAD_ACCUM = 8
BATCH_SIZE = 12
SEQ_LEN = 2048


def shuffle_key(keys: Sequence[str], seed: int = SEED, epoch=0) -> Column:
    """``md5('<seed>:<epoch>:<k1>:<k2>..')``: reproducible, different per epoch."""
    ep = epoch if isinstance(epoch, Column) else F.lit(epoch)
    parts = [F.lit(str(seed)), ep.cast("string")] + [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def shuffle_order(df: DataFrame, keys: Sequence[str], seed: int = SEED, epoch: int = 0) -> DataFrame:
    """The samples in seeded order (a distributed range sort)."""
    return (df.withColumn("shuffle_key", shuffle_key(keys, seed, epoch))
            .orderBy("shuffle_key", *keys))


def with_epochs(df: DataFrame, epochs: int, first_epoch: int = 0) -> DataFrame:
    """One copy of every sample per epoch (a generator, not a join)."""
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(first_epoch), F.lit(first_epoch + epochs - 1))))


def indexed(df: DataFrame, keys: Sequence[str], seed: int = SEED) -> DataFrame:
    """E1 + E2 per epoch: ``pos`` in the epoch's seeded order and ``n_total``."""
    keyed = df.withColumn("shuffle_key", shuffle_key(keys, seed, F.col("epoch")))
    return dense_index_by_hash(keyed, "shuffle_key", keys, group=["epoch"], out="pos", total="n_total")


def shard(df: DataFrame, world_size: int) -> DataFrame:
    """Wrap-pad to a multiple of W, then ``rank``/``pos_in_rank``.

    Needs ``pos`` and ``n_total`` (from ``indexed``). The fewer than W padding
    copies per epoch are emitted by the rows themselves (narrow, no join)."""
    w = F.lit(world_size).cast("bigint")
    rank_size = ceil_div("n_total", world_size)
    padded_total = rank_size * w
    copies = F.sequence(F.col("pos"), padded_total - 1, F.col("n_total"))  # more than two only where n < W
    out = df.withColumn("pos", F.explode(copies))
    return (out.withColumn("rank", F.pmod(F.col("pos"), w).cast("int"))
            .withColumn("pos_in_rank", idiv("pos", world_size))
            .withColumn("rank_size", rank_size))


def batch(df: DataFrame, batch_size: int, drop_last: bool = False) -> DataFrame:
    """``batch_idx`` and ``pos_in_batch``; ``drop_last`` drops the short last batch."""
    b = F.lit(batch_size).cast("bigint")
    out = (df.withColumn("batch_idx", idiv("pos_in_rank", batch_size))
           .withColumn("pos_in_batch", F.pmod(F.col("pos_in_rank"), b).cast("int")))
    n_batches = idiv("rank_size", batch_size) if drop_last else ceil_div("rank_size", batch_size)
    out = out.withColumn("n_batches", n_batches)
    return out.where(F.col("batch_idx") < F.col("n_batches")) if drop_last else out


def opt_steps(df: DataFrame, grad_accum: int = GRAD_ACCUM) -> DataFrame:
    """E5: ``opt_step`` (null for a trailing group of < G batches), ``steps_per_epoch``."""
    spe = idiv("n_batches", grad_accum)
    step = idiv("batch_idx", grad_accum)
    return (df.withColumn("steps_per_epoch", spe)
            .withColumn("opt_step", F.when(step < spe, step)))


def training_plan(samples: DataFrame, keys: Sequence[str] = ("doc_id", "chunk_idx"), epochs: int = 1,
                  world_size: int = 1, batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM,
                  seed: int = SEED, drop_last: bool | None = None) -> DataFrame:
    """Every (epoch, rank, batch, position) of a run, one row per sample visit.

    ``drop_last`` defaults to the reference's rule: kept when sharded (W > 1),
    dropped by the single-process loader."""
    if drop_last is None:
        drop_last = world_size == 1
    base = with_epochs(samples.select(*keys), epochs)
    plan = opt_steps(batch(shard(indexed(base, keys, seed), world_size), batch_size, drop_last),
                     grad_accum)
    return plan.select("epoch", "rank", "batch_idx", "opt_step", "pos_in_batch", "pos_in_rank", "pos",
                       *keys, "steps_per_epoch")


def resume_skip(global_step: int, steps_per_epoch: int, grad_accum: int = GRAD_ACCUM) -> int:
    """Micro-batches to skip in the first resumed epoch."""
    if global_step <= 0 or steps_per_epoch <= 0:
        return 0
    return (global_step % steps_per_epoch) * grad_accum


def resume_from(plan: DataFrame, checkpoint_epoch: int, global_step: int,
                steps_per_epoch: int | None = None, grad_accum: int = GRAD_ACCUM,
                strict: bool = False) -> DataFrame:
    """F8: the part of ``plan`` still to run after resuming a checkpoint.

    ``checkpoint_epoch`` is 1-based as saved. As in the reference, a checkpoint
    taken at the end of an epoch gives skip 0 in that same epoch, so the epoch runs
    again; ``strict=True`` moves on to the next epoch instead. Without
    ``steps_per_epoch`` the plan's own ``steps_per_epoch`` column is used."""
    e0 = F.lit(checkpoint_epoch - 1)
    spe = F.col("steps_per_epoch") if steps_per_epoch is None else F.lit(steps_per_epoch)
    gs = F.lit(global_step).cast("bigint")
    active = (gs > 0) & (spe > 0)
    skip = F.when(active, (gs % spe) * F.lit(grad_accum)).otherwise(F.lit(0))
    if strict:
        at_end = active & (gs % spe == 0)
        e0 = F.when(at_end, e0 + 1).otherwise(e0)
    return plan.where((F.col("epoch") > e0) | ((F.col("epoch") == e0) & (F.col("batch_idx") >= skip)))


def run_steps(samples: DataFrame, epochs: int = 1, world_size: int = 1, batch_size: int = BATCH_SIZE,
              grad_accum: int = GRAD_ACCUM, drop_last: bool | None = None) -> DataFrame:
    """One row per completed optimizer step of a run: ``epoch, opt_step,
    steps_per_epoch, global_step``. They follow from the number of samples alone, so the
    samples are counted and neither hashed, sorted nor shuffled."""
    if drop_last is None:
        drop_last = world_size == 1
    counted = samples.agg(F.count(F.lit(1)).alias("n"))
    rank_size = ceil_div("n", world_size)
    batches = idiv(rank_size, batch_size) if drop_last else ceil_div(rank_size, batch_size)
    spe = counted.select(idiv(batches, grad_accum).alias("steps_per_epoch")).where("steps_per_epoch > 0")
    zero = F.lit(0).cast("bigint")
    steps = (spe.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
             .withColumn("opt_step", F.explode(F.sequence(zero, F.col("steps_per_epoch") - 1))))
    return steps.select("epoch", "opt_step", "steps_per_epoch",
                        (F.col("epoch") * F.col("steps_per_epoch") + F.col("opt_step") + 1).alias("global_step"))


def checkpoint_steps(steps: DataFrame, save_interval: int) -> DataFrame:
    """the steps (``run_steps``) after which a mid-epoch checkpoint is saved."""
    return steps.where(F.col("global_step") % save_interval == 0) if save_interval > 0 else steps.where(F.lit(False))


def token_account(steps: DataFrame, seq_len: int = SEQ_LEN, batch_size: int = BATCH_SIZE,
                  grad_accum: int = GRAD_ACCUM, world_size: int = 1) -> DataFrame:
    """Tokens per step ``seq_len*B*G*W`` (padding included) and the running total.

    Every step adds the same amount, so the running total is ``global_step * per
    step``: no ordered window over all steps."""
    per_step = seq_len * batch_size * grad_accum * world_size
    return (steps.withColumn("tokens_step", F.lit(per_step).cast("bigint"))
            .withColumn("tokens_total", F.col("global_step") * F.lit(per_step).cast("bigint")))


def batch_sizes(plan: DataFrame, batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM,
                world_size: int = 1) -> DataFrame:
    """M6: configured effective (B*G) and global (B*G*W) batch next to the samples
    each optimizer step really holds."""
    return (plan.where(F.col("opt_step").isNotNull())
            .groupBy("epoch", "opt_step").agg(F.count(F.lit(1)).alias("samples"))
            .withColumn("effective_batch", F.lit(batch_size * grad_accum).cast("bigint"))
            .withColumn("global_batch", F.lit(batch_size * grad_accum * world_size).cast("bigint")))
