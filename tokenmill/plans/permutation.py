"""A keyed permutation of ``0 .. n-1`` in column arithmetic, and loader plans by it.

A shuffle that needs no sort: a sample's position in an epoch is a function of its dense
index, the seed and the epoch, and the function has an inverse. So a plan of many epochs
costs one index and then narrow arithmetic, and a resume point, or the samples of any one
step, follow from the step number without planning the epoch.

The permutation is a Feistel network on ``a x b >= n`` places (``a`` the next integer over
``sqrt(n)``, ``b = ceil(n / a)``): a number is split into ``l = x mod a`` and
``r = x div a``, and each round maps ``(l, r)`` to ``(r, (l + f(r, key)) mod m)``, ``m`` being
``a`` and ``b`` in turn. Fewer than ``a`` places are over; a number that lands on one walks on
until it is under ``n``, which takes at most as many steps as there are such places, and
all but about one number in ``sqrt(n)`` take none.

``f`` is two multiplications of which the middle bits are kept, so every intermediate fits
a BIGINT and other engines compute the same. ``n`` may be at most 2^62. The order is
mixed well enough for training, and is no cipher.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions._cols import idiv
from tokenmill.plans.index import dense_index
from tokenmill.plans.sampling import BATCH_SIZE, GRAD_ACCUM, SEED, batch, opt_steps, resume_skip, shard, with_epochs

FEISTEL_ROUNDS = 6
# Steps of a walk that are laid out at first; hardly a number in the world needs more.
FEW = 64
MASK = 2**32 - 1
# Odd multipliers under 2^30, and how far their products are shifted.
MULTIPLIERS, SHIFT = (741103597, 887987685), 15


def _long(x: int | Column) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("bigint")


def _f(r: Column, key: Column) -> Column:
    x = (r + key).bitwiseAND(F.lit(MASK).cast("bigint"))
    for m in MULTIPLIERS:
        x = F.shiftright(x * F.lit(m).cast("bigint"), SHIFT).bitwiseAND(F.lit(MASK).cast("bigint"))
    return x


def round_key(seed: int, epoch: Column, j: int) -> Column:
    """The key of round ``j``: the same mixing of seed, round and epoch."""
    start = (seed * MULTIPLIERS[0] + (j + 1) * MULTIPLIERS[1]) & MASK
    return _f(_f(epoch.cast("bigint"), F.lit(start).cast("bigint")), F.lit(start ^ MASK).cast("bigint"))


def sides(n: int) -> tuple[int, int]:
    """``(a, b)`` of the network's places."""
    a = math.isqrt(n) + 1
    return a, -(-n // a)


def _turn(left: Column, right: Column, m: Column, key: Column, inverse: bool) -> tuple[Column, Column]:
    """One round, or one taken back."""
    if inverse:
        return F.pmod(right - _f(left, key), m), left
    return right, F.pmod(left + _f(right, key), m)


def _walk(start: Column, n: int, a: int, b: int, keys: list[Column], steps: Column, inverse: bool) -> Column:
    """On from a place over ``n`` until under it; run for few rows, so it is kept small."""
    order = range(FEISTEL_ROUNDS)
    turns = F.array(*[F.struct(_long(a if j % 2 == 0 else b).alias("m"), keys[j].alias("key"))
                      for j in (reversed(order) if inverse else order)])

    def turn(state: Column, t: Column) -> Column:
        left, right = _turn(state["l"], state["r"], t["m"], t["key"], inverse)
        return F.struct(left.alias("l"), right.alias("r"))

    def step(y: Column) -> Column:
        first = F.struct(F.pmod(y, _long(a)).alias("l"), idiv(y, a).alias("r"))
        return F.aggregate(turns, first, turn, lambda s: s["r"] * _long(a) + s["l"])

    return F.aggregate(F.sequence(_long(1), steps), start, lambda y, _: F.when(y < n, y).otherwise(step(y)))


def permute(df: DataFrame, x: str, n: int, out: str, seed: int = SEED, epoch: int | Column = 0, inverse: bool = False) -> DataFrame:
    """``df`` with ``out``: where ``x`` of ``0 .. n-1`` lies in the order of ``seed`` and ``epoch``,
    or, with ``inverse``, which number lies at place ``x``. Narrow, and a projection per
    round, so that no expression is worked out twice."""
    if n <= 1:
        return df.withColumn(out, _long(F.col(x)))
    a, b = sides(n)
    over = a * b - n
    left, right, one = (f"__{out}_{c}" for c in ("l", "r", "one"))
    at_epoch = _long(epoch)
    keys = [round_key(seed, at_epoch, j) for j in range(FEISTEL_ROUNDS)]
    done = df.withColumns({left: F.pmod(_long(F.col(x)), _long(a)), right: idiv(x, a)})
    for j in reversed(range(FEISTEL_ROUNDS)) if inverse else range(FEISTEL_ROUNDS):
        nl, nr = _turn(F.col(left), F.col(right), _long(a if j % 2 == 0 else b), keys[j], inverse)
        done = done.withColumns({left: nl, right: nr})
    done = done.withColumn(one, F.col(right) * _long(a) + F.col(left))
    place = F.col(one)
    if over:  # the bounds depend on the row, so that no list of steps is laid out for nothing
        few = _walk(place, n, a, b, keys, F.when(place < n, 1).otherwise(min(over, FEW)).cast("bigint"), inverse)
        far = few if over <= FEW else F.when(few < n, few).otherwise(
            _walk(few, n, a, b, keys, F.when(place < n, 1).otherwise(over - FEW).cast("bigint"), inverse))
        place = F.when(place < n, place).otherwise(far)
    return done.withColumn(out, place).drop(left, right, one)


def permuted_plan(samples: DataFrame, keys: Sequence[str] = ("doc_id", "chunk_idx"), epochs: int = 1, world_size: int = 1,
                  batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM, seed: int = SEED, drop_last: bool | None = None,
                  index: str | None = None, n: int | None = None) -> DataFrame:
    """E6 by permutation: the columns of ``training_plan`` and ``idx``, the sample's dense
    index in the order of its ``keys`` (a total order).

    One shuffle makes the index; every epoch follows without one. Samples that have an
    index already (``write_indexed``: pass its column as ``index`` and the count as
    ``n``) are not shuffled at all."""
    if drop_last is None:
        drop_last = world_size == 1
    if index is None:
        indexed = dense_index(samples.select(*keys), list(keys), out="idx", total=None)
    else:
        indexed = samples.select(*keys, F.col(index).cast("bigint").alias("idx"))
    total = indexed.count() if n is None else n
    placed = with_epochs(indexed, epochs).withColumn("n_total", F.lit(total).cast("bigint"))
    placed = permute(placed, "idx", total, "pos", seed, F.col("epoch"))
    plan = opt_steps(batch(shard(placed, world_size), batch_size, drop_last), grad_accum)
    return plan.select("epoch", "rank", "batch_idx", "opt_step", "pos_in_batch", "pos_in_rank", "pos", "idx", *keys, "steps_per_epoch")


def epoch_places(spark: SparkSession, n: int, epoch: int, first_batch: int = 0, end_batch: int | None = None, world_size: int = 1,
                 batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM, seed: int = SEED,
                 drop_last: bool | None = None) -> DataFrame:
    """The places of one epoch's micro-batches ``first_batch`` to before ``end_batch``, with
    the sample index at each, from arithmetic alone: the plan's columns but the keys."""
    if drop_last is None:
        drop_last = world_size == 1
    rank_size = -(-n // world_size)
    batches = rank_size // batch_size if drop_last else -(-rank_size // batch_size)
    end = min(rank_size, batch_size * (batches if end_batch is None else min(end_batch, batches)))
    places = spark.range(min(first_batch * batch_size, end) * world_size, end * world_size).withColumnRenamed("id", "pos")
    w, steps = F.lit(world_size).cast("bigint"), batches // grad_accum
    rows = places.select(F.lit(epoch).alias("epoch"), F.pmod(F.col("pos"), w).cast("int").alias("rank"), idiv("pos", world_size).alias("pos_in_rank"), "pos")
    step = idiv(idiv("pos_in_rank", batch_size), grad_accum)
    inside = F.pmod(F.col("pos"), _long(max(n, 1)))  # the padding repeats the first places
    found = permute(rows.withColumn("inside", inside), "inside", n, "idx", seed, epoch, inverse=True)
    return found.select("epoch", "rank", idiv("pos_in_rank", batch_size).alias("batch_idx"), F.when(step < steps, step).alias("opt_step"),
                        F.pmod(F.col("pos_in_rank"), F.lit(batch_size).cast("bigint")).cast("int").alias("pos_in_batch"), "pos_in_rank", "pos",
                        "idx", F.lit(steps).cast("bigint").alias("steps_per_epoch"))


def resume_places(spark: SparkSession, n: int, checkpoint_epoch: int, global_step: int, epochs: int, world_size: int = 1,
                  batch_size: int = BATCH_SIZE, grad_accum: int = GRAD_ACCUM, seed: int = SEED, drop_last: bool | None = None) -> DataFrame:
    """F8 by permutation: what is left of a run after a checkpoint (as ``resume_from``),
    without planning what is done. ``checkpoint_epoch`` is 1-based, as saved."""
    one = dict(world_size=world_size, batch_size=batch_size, grad_accum=grad_accum, seed=seed, drop_last=drop_last)
    rank_size = -(-n // world_size)
    drop = world_size == 1 if drop_last is None else drop_last
    steps = (rank_size // batch_size if drop else -(-rank_size // batch_size)) // grad_accum
    first = checkpoint_epoch - 1
    out = epoch_places(spark, n, first, resume_skip(global_step, steps, grad_accum), **one)
    for epoch in range(first + 1, epochs):
        out = out.unionByName(epoch_places(spark, n, epoch, **one))
    return out
