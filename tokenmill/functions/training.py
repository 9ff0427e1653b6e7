"""Scalar training arithmetic as columns: WSD learning rate, FLOPs per token,
MFU, batch sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions._cols import as_col

# Fixed values of the reference's schedule and formula.
WSD_DEFAULTS = {
    "peak_lr": 3.0e-4,
    "min_lr": 3.0e-5,
    "warmup_steps": 20000,
    "decay_steps": 60000,
    "total_steps": 288630,
}
FLOPS_SEQ_LEN = 2048  # sequence length fixed inside the FLOPs formula


def _lit(x) -> Column:
    """Column as is, a string as a column name, anything else as a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(x)


def wsd_lr(step, peak_lr: float = WSD_DEFAULTS["peak_lr"], min_lr: float = WSD_DEFAULTS["min_lr"],
           warmup_steps: int = WSD_DEFAULTS["warmup_steps"],
           decay_start_step: int | None = None,
           decay_steps: int = WSD_DEFAULTS["decay_steps"],
           total_steps: int = WSD_DEFAULTS["total_steps"]) -> Column:
    """Warmup-stable-decay learning rate at optimizer step ``step`` (0-based).

    Warm-up ramps ``peak*(step+1)/warmup``; flat until ``decay_start_step``
    (default ``total_steps - decay_steps``); then linear decay to ``min_lr`` with the
    progress clamped to [0, 1]; ``decay_steps <= 0`` gives ``min_lr`` in that phase."""
    s = as_col(step).cast("double")
    if decay_start_step is None:
        decay_start_step = total_steps - decay_steps
    peak, lo = F.lit(float(peak_lr)), F.lit(float(min_lr))
    if decay_steps <= 0:
        decay = lo
    else:
        progress = F.least(F.lit(1.0), F.greatest(F.lit(0.0),
                                                  (s - F.lit(float(decay_start_step))) / F.lit(float(decay_steps))))
        decay = peak - (peak - lo) * progress
    return (F.when(s < F.lit(warmup_steps), peak * (s + 1) / F.lit(float(warmup_steps)))
            .when(s < F.lit(decay_start_step), peak)
            .otherwise(decay))


def flops_per_token(n_params, seq_len=FLOPS_SEQ_LEN, hidden_size=None, vocab_size=None,
                    num_layers=None) -> Column:
    """``6N(1 + s/12h + V/16Lh)``; ``6N`` when any of h, V, L is missing (null)."""
    n = _lit(n_params).cast("double")
    s, h = _lit(seq_len).cast("double"), _lit(hidden_size).cast("double")
    v, layers = _lit(vocab_size).cast("double"), _lit(num_layers).cast("double")
    detailed = F.lit(6.0) * n * (F.lit(1.0) + s / (F.lit(12.0) * h) + v / (F.lit(16.0) * layers * h))
    return F.coalesce(detailed, F.lit(6.0) * n)


def mfu(tokens, step_time, flops_per_tok, peak_flops) -> Column:
    """Model FLOPs utilisation, capped at 1; 0 when time, peak or flops is <= 0."""
    t, f, p = _lit(step_time).cast("double"), _lit(flops_per_tok).cast("double"), _lit(peak_flops).cast("double")
    raw = _lit(tokens).cast("double") * f / t / p
    return F.when((t <= 0) | (p <= 0) | (f <= 0), F.lit(0.0)).otherwise(F.least(raw, F.lit(1.0)))


def effective_batch(batch_size, grad_accum) -> Column:
    return _lit(batch_size).cast("bigint") * _lit(grad_accum).cast("bigint")


def global_batch(batch_size, grad_accum, world_size) -> Column:
    return effective_batch(batch_size, grad_accum) * _lit(world_size).cast("bigint")
