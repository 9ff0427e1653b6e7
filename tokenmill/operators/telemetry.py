"""Training step telemetry from a micro-batch log ``(epoch, rank, batch_idx, ts, loss)``.

All aggregations group by the step (``(epoch, rank, batch_idx / G)``), a key
with G rows each, so there is no hot key; per-epoch figures are computed from the
small per-step table. Nothing is ordered over the whole log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions._cols import idiv
from tokenmill.functions.training import mfu, wsd_lr
from tokenmill.plans.sampling import BATCH_SIZE, GRAD_ACCUM, SEQ_LEN
from tokenmill.schemas import require_columns

# Fixed values of the reference: peak tensor FLOP/s by the first key found in the
# device name, in this priority order; unknown devices get the default; no device 0.
GPU_PEAK_FLOPS: tuple[tuple[str, float], ...] = (
    ("V100", 125e12),
    ("A100", 312e12),
    ("H100", 989e12),
    ("3090", 142e12),
    ("4090", 330e12),
    ("T4", 130e12),
)
GPU_PEAK_DEFAULT = 100e12
LOG_EVERY = 10


def gpu_peak(name, table: Sequence[tuple[str, float]] = GPU_PEAK_FLOPS,
             default: float = GPU_PEAK_DEFAULT) -> Column:
    """Peak FLOP/s of a device by the first table key contained in its name.

    A ``CASE`` chain in table order is exactly "first key wins": no join needed."""
    n = F.col(name) if isinstance(name, str) else name
    out = None
    for key, flops in table:
        cond = F.instr(n, key) > 0
        out = F.when(cond, F.lit(float(flops))) if out is None else out.when(cond, F.lit(float(flops)))
    out = out.otherwise(F.lit(float(default))) if out is not None else F.lit(float(default))
    return F.when(n.isNull(), F.lit(0.0)).otherwise(out)


# Keys that a device table may have to be broadcast.
MAX_DEVICE_KEYS = 10_000


def device_peaks(rows: DataFrame, name: str, table: DataFrame, out: str = "peak_flops",
                 default: float = GPU_PEAK_DEFAULT) -> DataFrame:
    """M4 from a table: ``rows`` with ``out``, the ``flops`` of the key that the device ``name``
    contains; of several the one of the lowest ``priority``. No key: the default; no
    device: 0. ``table``: ``key, flops, priority``, of which the keys are not empty.

    Distinct names meet the keys (a theta join against a table whose size is checked),
    so a device with many rows is looked up once."""
    n = table.limit(MAX_DEVICE_KEYS + 1).count()
    if n > MAX_DEVICE_KEYS:
        raise ValueError(f"a device table of more than {MAX_DEVICE_KEYS} keys")
    names = rows.select(F.col(name).alias("__name")).where("__name IS NOT NULL").distinct()
    keys = table.where("key <> ''").select("key", "flops", "priority")
    met = names.join(F.broadcast(keys), F.contains("__name", "key"))
    best = met.groupBy("__name").agg(F.min(F.struct("priority", "key", "flops")).alias("__best"))
    joined = rows.join(best, F.col(name) == F.col("__name"), "left")
    peak = F.when(F.col(name).isNull(), F.lit(0.0)).otherwise(F.coalesce(F.col("__best.flops").cast("double"), F.lit(float(default))))
    return joined.withColumn(out, peak).drop("__name", "__best")


def step_loss(log: DataFrame, grad_accum: int = GRAD_ACCUM) -> DataFrame:
    """One row per completed optimizer step.

    ``loss`` is the sum of ``loss / G`` over the step's micro-batches (as the trainer
    accumulates it); a step is complete when its closing micro-batch
    (``batch_idx % G == G - 1``) is in the log. ``step_time`` is the span of the
    step's micro-batch times in seconds."""
    require_columns(log, "epoch", "rank", "batch_idx", "ts", "loss")
    g = F.lit(grad_accum).cast("bigint")
    closing = F.when(F.col("batch_idx") % g == g - 1, F.lit(1))
    steps = (log.withColumn("opt_step", idiv("batch_idx", grad_accum))
             .groupBy("epoch", "rank", "opt_step")
             .agg(F.sum(F.col("loss") / g).alias("loss"),
                  F.count(F.lit(1)).alias("micro_batches"),
                  F.max(closing).alias("__closed"),
                  F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
                  F.max("batch_idx").alias("last_batch")))
    return (steps.where(F.col("__closed").isNotNull()).drop("__closed")
            .withColumn("step_time",
                        F.timestamp_diff("MICROSECOND", F.col("start_ts"), F.col("end_ts")).cast("double")
                        / F.lit(1e6)))


def with_global_step(steps: DataFrame, log: DataFrame | None = None, steps_per_epoch: int | None = None,
                     grad_accum: int = GRAD_ACCUM) -> DataFrame:
    """``step`` (1-based within the epoch) and ``global_step = epoch * spe + step``.

    Without ``steps_per_epoch`` it is taken from ``log``: the last closing micro-batch
    of an epoch ends its last step, so a maximum per epoch over the raw log (summed per
    task, a few rows shuffled, broadcast back) does it without a second pass by step."""
    out = steps.withColumn("step", F.col("opt_step") + 1)
    if steps_per_epoch is None:
        g = F.lit(grad_accum).cast("bigint")
        spe = (log.where(F.col("batch_idx") % g == g - 1).groupBy("epoch")
               .agg(idiv(F.max("batch_idx") + 1, grad_accum).alias("steps_per_epoch")))
        out = out.join(F.broadcast(spe), "epoch")  # one row per epoch
    else:
        out = out.withColumn("steps_per_epoch", F.lit(steps_per_epoch).cast("bigint"))
    return out.withColumn("global_step", F.col("epoch") * F.col("steps_per_epoch") + F.col("step"))


def log_every(steps: DataFrame, n: int = LOG_EVERY) -> DataFrame:
    """the steps the trainer logs (1-based step in epoch divisible by ``n``)."""
    return steps.where(F.col("step") % n == 0)


def step_rates(steps: DataFrame, flops_tok, peak, world_size: int = 1, seq_len: int = SEQ_LEN,
               batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM) -> DataFrame:
    """M5 (+ M3): global tokens/s, effective TFLOPS and MFU of each step; 0 when the
    step time is not positive."""
    tokens_local = seq_len * batch_size * grad_accum
    t = F.col("step_time")
    f = flops_tok if isinstance(flops_tok, Column) else F.lit(float(flops_tok))
    p = peak if isinstance(peak, Column) else F.lit(float(peak))
    pos = t > 0
    return (steps
            .withColumn("tokens_per_second",
                        F.when(pos, F.lit(float(tokens_local * world_size)) / t).otherwise(F.lit(0.0)))
            .withColumn("tflops",
                        F.when(pos & (f > 0), F.lit(float(tokens_local * world_size)) * f / t / F.lit(1e12))
                        .otherwise(F.lit(0.0)))
            .withColumn("mfu_percent", mfu(F.lit(tokens_local), t, f, p) * F.lit(100.0)))


def lr_schedule(spark, total_steps: int | None = None, **wsd) -> DataFrame:
    """M1 as a table ``(step, lr)`` for every optimizer step of a run (a
    distributed ``range``, one narrow projection)."""
    from tokenmill.functions.training import WSD_DEFAULTS
    n = total_steps if total_steps is not None else wsd.get("total_steps", WSD_DEFAULTS["total_steps"])
    return spark.range(n).select(F.col("id").alias("step"), wsd_lr(F.col("id"), **wsd).alias("lr"))


def lr_by_step(steps: DataFrame, **wsd) -> DataFrame:
    """M1 on the log: WSD learning rate after each completed global step."""
    return steps.withColumn("lr", wsd_lr(F.col("global_step"), **wsd))


def epoch_summary(steps: DataFrame, world_size: int = 1, seq_len: int = SEQ_LEN,
                  batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM) -> DataFrame:
    """Per epoch, time since the run's first micro-batch, tokens so far and mean
    tokens/s (0 when no time has passed). Tokens and time come from the same rows."""
    per_step = seq_len * batch_size * grad_accum * world_size
    per_epoch = steps.groupBy("epoch").agg(F.count(F.lit(1)).alias("steps"),
                                          F.min("start_ts").alias("first_ts"), F.max("end_ts").alias("last_ts"))
    w_all = Window.partitionBy()
    w_cum = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    out = (per_epoch
           .withColumn("run_start", F.min("first_ts").over(w_all))
           .withColumn("elapsed_seconds",
                       F.timestamp_diff("MICROSECOND", F.col("run_start"), F.col("last_ts")).cast("double")
                       / F.lit(1e6))
           .withColumn("total_tokens", F.sum(F.col("steps") * F.lit(per_step)).over(w_cum).cast("bigint")))
    return (out.withColumn("avg_tokens_per_second",
                           F.when(F.col("elapsed_seconds") > 0, F.col("total_tokens") / F.col("elapsed_seconds"))
                           .otherwise(F.lit(0.0)))
            .select("epoch", "steps", "elapsed_seconds", "total_tokens", "avg_tokens_per_second"))


def resumed_epoch_summary(log: DataFrame, gap_seconds: float, grad_accum: int = GRAD_ACCUM, world_size: int = 1,
                          seq_len: int = SEQ_LEN, batch_size: int = BATCH_SIZE) -> DataFrame:
    """G6 for a run that was stopped and resumed: one row per rank and epoch of a log in which
    a pause longer than ``gap_seconds`` splits the run (``session_window``).

    ``runs`` and ``active_seconds`` (the time inside the runs; pauses don't count),
    ``pause_seconds``, ``steps`` (a step that was run again after a resume counts once),
    ``repeated`` (micro-batches run again), and, over the epochs so far, ``total_tokens``
    and ``avg_tokens_per_second`` of active time (0 when no time has passed)."""
    require_columns(log, "epoch", "rank", "batch_idx", "ts")
    g = F.lit(grad_accum).cast("bigint")
    gap = f"{round(gap_seconds * 1e6)} microseconds"
    seconds = lambda a, b: F.timestamp_diff("MICROSECOND", a, b).cast("double") / F.lit(1e6)
    sessions = log.groupBy("rank", "epoch", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"))
    time = sessions.groupBy("rank", "epoch").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.timestamp_diff("MICROSECOND", F.col("first"), F.col("last"))).alias("active_us"),
        seconds(F.min("first"), F.max("last")).alias("span"))
    batches = log.groupBy("rank", "epoch", "batch_idx").agg(F.count(F.lit(1)).alias("n"))
    closing = F.when(F.col("batch_idx") % g == g - 1, F.lit(1))
    done = batches.groupBy("rank", "epoch").agg(F.count(closing).alias("steps"), F.sum(F.col("n") - 1).alias("repeated"))
    so_far = Window.partitionBy("rank").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    per_step = seq_len * batch_size * grad_accum * world_size
    out = (time.join(done, ["rank", "epoch"]).withColumn("active_seconds", F.col("active_us").cast("double") / F.lit(1e6))
           .withColumn("total_tokens", F.sum(F.col("steps") * F.lit(per_step)).over(so_far).cast("bigint"))
           .withColumn("total_us", F.sum("active_us").over(so_far).cast("double") / F.lit(1e6)))
    return out.select("rank", "epoch", "runs", "active_seconds", (F.col("span") - F.col("active_seconds")).alias("pause_seconds"),
                      "steps", "repeated", "total_tokens",
                      F.when(F.col("total_us") > 0, F.col("total_tokens") / F.col("total_us")).otherwise(F.lit(0.0)).alias("avg_tokens_per_second"))


def step_log(steps: DataFrame, flops_tok, peak, epochs: int, world_size: int = 1, seq_len: int = SEQ_LEN,
             batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM, every: int = LOG_EVERY, **wsd) -> DataFrame:
    """The trainer's log record, every ``every``-th step of an epoch: loss, learning rate,
    epoch (1-based), step, global step, rates and batch counts in one row. (The gradient
    norm is known on the device only.) Needs ``with_global_step``."""
    rated = step_rates(lr_by_step(log_every(steps, every), **wsd), flops_tok, peak, world_size, seq_len, batch_size,
                       grad_accum)
    return rated.select(
        (F.col("epoch") + 1).alias("epoch"), F.lit(epochs).alias("epochs"), "step", "steps_per_epoch", "global_step", "loss",
        "lr", "tokens_per_second", "mfu_percent", "step_time", "tflops", F.lit(world_size).alias("gpu_count"),
        F.lit(batch_size).alias("batch_size"),
        F.lit(batch_size * grad_accum * world_size).alias("effective_batch_size"))


def macro_average(scores: DataFrame, drop_zero: bool = False) -> DataFrame:
    """Mean of per-subject accuracy by method, optionally leaving out zero scores."""
    acc = F.col("accuracy")
    val = F.when(acc > 0, acc) if drop_zero else acc
    return scores.groupBy("method").agg(F.avg(val).alias("macro_avg"),
                                        F.count(val).alias("subjects"))


__all__ = ["gpu_peak", "device_peaks", "resumed_epoch_summary", "step_loss", "with_global_step", "log_every", "step_rates", "lr_schedule", "lr_by_step",
           "epoch_summary", "step_log", "macro_average"]
