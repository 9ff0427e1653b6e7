"""Registered queries: the loader as tables over the blocks of every document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.operators import blocks as B
from tokenmill.plans import permutation as P
from tokenmill.plans import sampling as S
from tokenmill.plans.index import dense_index, dense_index_by_hash
from tokenmill.queries.block_queries import L, MIN_LEN, STRIDE
from tokenmill.registry import register

EPOCHS, WORLD, BATCH, ACCUM, SEED = 2, 4, 8, 4, 42
RESUME_EPOCH, RESUME_STEP, SAVE_EVERY = 1, 7, 5
KEYS = ("doc_id", "chunk_idx")


def sample_keys(spark, sf_dir):
    """(doc_id, chunk_idx) of every block of every document, no token arrays."""
    return B.block_keys(inputs.table(spark, sf_dir, "documents"), "text", L, STRIDE, MIN_LEN).select(*KEYS)


def plan(spark, sf_dir, epochs=EPOCHS):
    return S.training_plan(sample_keys(spark, sf_dir), KEYS, epochs, WORLD, BATCH, ACCUM, SEED)


def run(spark, sf_dir):
    return S.run_steps(sample_keys(spark, sf_dir), EPOCHS, WORLD, BATCH, ACCUM)


# ---- DuckDB twin of the plan ---------------------------------------------------------

_KEYS_SQL = f"""words AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS n FROM documents),
starts AS (
  SELECT doc_id, CASE WHEN n <= {L} THEN [0]
    ELSE list_filter(range(0, greatest(0, (n - {L} + {STRIDE - 1}) // {STRIDE}) * {STRIDE} + 1, {STRIDE}),
                     lambda s: s < n AND least({L}, n - s) >= {MIN_LEN}) END AS st FROM words),
keys AS (
  SELECT doc_id, unnest(st) AS s, CAST(generate_subscripts(st, 1) - 1 AS INTEGER) AS chunk_idx FROM starts)"""


def _plan_sql(epochs=EPOCHS, world=WORLD, batch=BATCH, accum=ACCUM, seed=SEED) -> str:
    return f"""{_KEYS_SQL},
ep AS (SELECT CAST(unnest(range(0, {epochs})) AS INTEGER) AS epoch),
k AS (SELECT epoch, doc_id, chunk_idx,
             md5('{seed}:' || epoch || ':' || doc_id || ':' || chunk_idx) AS shuffle_key
      FROM keys CROSS JOIN ep),
idx AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY shuffle_key, doc_id, chunk_idx) - 1 AS pos,
               count(*) OVER (PARTITION BY epoch) AS n_total FROM k),
padded AS (
  SELECT epoch, doc_id, chunk_idx, pos, n_total FROM idx
  UNION ALL
  SELECT epoch, doc_id, chunk_idx, pos + n_total, n_total FROM idx
  WHERE pos < CAST(ceil(n_total / {world}) AS BIGINT) * {world} - n_total),
sh AS (SELECT *, CAST(pos % {world} AS INTEGER) AS rank, pos // {world} AS pos_in_rank,
              CAST(ceil(n_total / {world}) AS BIGINT) AS rank_size FROM padded),
bt AS (SELECT *, pos_in_rank // {batch} AS batch_idx, CAST(pos_in_rank % {batch} AS INTEGER) AS pos_in_batch,
              CAST(ceil(rank_size / {batch}) AS BIGINT) AS n_batches FROM sh),
pl AS (SELECT *, n_batches // {accum} AS steps_per_epoch,
              CASE WHEN batch_idx // {accum} < n_batches // {accum} THEN batch_idx // {accum} END AS opt_step
       FROM bt),
steps AS (SELECT epoch, opt_step, steps_per_epoch, epoch * steps_per_epoch + opt_step + 1 AS global_step
          FROM pl WHERE rank = 0 AND pos_in_batch = 0 AND opt_step IS NOT NULL
                    AND batch_idx % {accum} = {accum - 1})"""


_PLAN_COLS = "epoch, rank, batch_idx, opt_step, pos_in_batch, pos_in_rank, pos, doc_id, chunk_idx, steps_per_epoch"


@register("shuffle_order", sql=f"""
WITH {_KEYS_SQL}
SELECT doc_id, chunk_idx, md5('{SEED}:0:' || doc_id || ':' || chunk_idx) AS shuffle_key FROM keys""")
def shuffle_order(spark, sf_dir):
    """Seeded, epoch-specific order key of every sample (globally sorted)."""
    return S.shuffle_order(sample_keys(spark, sf_dir), KEYS, SEED, 0).select(*KEYS, "shuffle_key")


@register("dense_index", sql=f"""
WITH {_KEYS_SQL}
SELECT k.doc_id, k.chunk_idx, d.text,
       row_number() OVER (ORDER BY md5('{SEED}:0:' || k.doc_id || ':' || k.chunk_idx),
                          k.doc_id, k.chunk_idx) - 1 AS pos
FROM keys k JOIN documents d ON k.doc_id = d.doc_id""")
def dense_index_q(spark, sf_dir):
    """0-based position in the seeded order, with the text carried along: a text is shuffled
    once, to meet the positions of its blocks, not once per block."""
    docs = inputs.table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("t"), F.col("text").isNull().alias("no"))
    mark = ["doc_id", "t", "no"]
    keys = B.block_keys(docs, "text", L, STRIDE, MIN_LEN).select(*KEYS)
    keyed = keys.join(docs.select(*mark), "doc_id").withColumn("shuffle_key", S.shuffle_key(KEYS, SEED, 0))
    placed = dense_index_by_hash(keyed, "shuffle_key", KEYS, total=None).drop("shuffle_key")
    copies = Window.partitionBy(*mark).orderBy("doc_id")  # rows equal in id and text stand for each other
    once = docs.withColumn("copy", F.row_number().over(copies)).where("copy = 1")
    return placed.join(once, mark).select(*KEYS, "text", "pos")


@register("rank_shards", sql=f"""
WITH {_plan_sql(epochs=1)}
SELECT doc_id, chunk_idx, pos, rank, pos_in_rank FROM sh""")
def rank_shards(spark, sf_dir):
    """Wrap-padded shards, one per rank."""
    base = S.with_epochs(sample_keys(spark, sf_dir), 1)
    return S.shard(S.indexed(base, KEYS, SEED), WORLD).select(*KEYS, "pos", "rank", "pos_in_rank")


@register("batches", sql=f"""
WITH {_plan_sql(epochs=1)}
SELECT doc_id, chunk_idx, rank, batch_idx, pos_in_batch FROM bt""")
def batches(spark, sf_dir):
    """Batches per rank (sharded loader keeps the short last batch)."""
    base = S.with_epochs(sample_keys(spark, sf_dir), 1)
    out = S.batch(S.shard(S.indexed(base, KEYS, SEED), WORLD), BATCH, drop_last=False)
    return out.select(*KEYS, "rank", "batch_idx", "pos_in_batch")


@register("opt_steps", sql=f"""
WITH {_plan_sql(epochs=1)}
SELECT doc_id, chunk_idx, rank, batch_idx, opt_step, steps_per_epoch FROM pl""")
def opt_steps(spark, sf_dir):
    """E5: optimizer step of each micro-batch; a trailing partial group is no step."""
    return plan(spark, sf_dir, epochs=1).select(*KEYS, "rank", "batch_idx", "opt_step", "steps_per_epoch")


@register("training_plan", sql=f"""
WITH {_plan_sql()}
SELECT {_PLAN_COLS} FROM pl""")
def training_plan(spark, sf_dir):
    """The full two-epoch, four-rank plan."""
    return plan(spark, sf_dir)


@register("resume_plan", sql=f"""
WITH {_plan_sql()}
SELECT {_PLAN_COLS} FROM pl
WHERE epoch > {RESUME_EPOCH - 1}
   OR (epoch = {RESUME_EPOCH - 1} AND batch_idx >= ({RESUME_STEP} % steps_per_epoch) * {ACCUM})""")
def resume_plan(spark, sf_dir):
    """F8: what is left after resuming at global step 7 of epoch 1 (1-based)."""
    return S.resume_from(plan(spark, sf_dir), RESUME_EPOCH, RESUME_STEP, grad_accum=ACCUM)


@register("checkpoint_steps", sql=f"""
WITH {_plan_sql()}
SELECT epoch, opt_step, steps_per_epoch, global_step FROM steps WHERE global_step % {SAVE_EVERY} = 0""")
def checkpoint_steps(spark, sf_dir):
    """global steps at which a mid-epoch checkpoint is written."""
    return S.checkpoint_steps(run(spark, sf_dir), SAVE_EVERY)


@register("token_account", sql=f"""
WITH {_plan_sql()}
SELECT epoch, opt_step, steps_per_epoch, global_step,
       CAST({S.SEQ_LEN * BATCH * ACCUM * WORLD} AS BIGINT) AS tokens_step,
       global_step * {S.SEQ_LEN * BATCH * ACCUM * WORLD} AS tokens_total FROM steps""")
def token_account(spark, sf_dir):
    """Tokens per optimizer step (padding counted) and the running total."""
    return S.token_account(run(spark, sf_dir), S.SEQ_LEN, BATCH, ACCUM, WORLD)


@register("batch_sizes", sql=f"""
WITH {_plan_sql()}
SELECT epoch, opt_step, count(*) AS samples, CAST({BATCH * ACCUM} AS BIGINT) AS effective_batch,
       CAST({BATCH * ACCUM * WORLD} AS BIGINT) AS global_batch
FROM pl WHERE opt_step IS NOT NULL GROUP BY epoch, opt_step""")
def batch_sizes(spark, sf_dir):
    """M6: effective and global batch size next to the samples each step holds."""
    return S.batch_sizes(plan(spark, sf_dir), BATCH, ACCUM, WORLD)


# ---- plans by permutation ------------------------------------------------------------

def _f_sql(r: str, key: str) -> str:
    x = f"(({r} + {key}) & {P.MASK})"
    for m in P.MULTIPLIERS:
        x = f"((({x} * {m}) >> {P.SHIFT}) & {P.MASK})"
    return x


def _network_sql(x: str, seed: int) -> str:
    left, right = f"({x} % a)", f"({x} // a)"
    for j in range(P.FEISTEL_ROUNDS):
        start = (seed * P.MULTIPLIERS[0] + (j + 1) * P.MULTIPLIERS[1]) & P.MASK
        key = _f_sql(_f_sql("epoch", str(start)), str(start ^ P.MASK))
        left, right = right, f"(({left} + {_f_sql(right, key)}) % {'b' if j % 2 else 'a'})"
    return f"({right} * a + {left})"


def _permuted_sql(epochs=EPOCHS, world=WORLD, batch=BATCH, accum=ACCUM, seed=SEED) -> str:
    """The plan whose order is the permutation of the dense index by key."""
    whole = _plan_sql(epochs, world, batch, accum, seed)
    after = whole[whole.index("padded AS ("):].replace("epoch, doc_id, chunk_idx, pos", "epoch, doc_id, chunk_idx, idx, pos")
    return f"""RECURSIVE {_KEYS_SQL},
ep AS (SELECT CAST(unnest(range(0, {epochs})) AS BIGINT) AS epoch),
dense AS (SELECT doc_id, chunk_idx, row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS idx, count(*) OVER () AS n_total FROM keys),
side AS (SELECT *, (n_total + a - 1) // a AS b FROM (SELECT max(n_total) AS n_total, CAST(floor(sqrt(max(n_total))) AS BIGINT) + 1 AS a FROM dense)),
walk AS (SELECT epoch, idx, {_network_sql("idx", seed)} AS pos FROM dense CROSS JOIN ep, side
         UNION ALL SELECT epoch, idx, {_network_sql("pos", seed)} FROM walk, side WHERE pos >= n_total),
idx AS (SELECT CAST(w.epoch AS INTEGER) AS epoch, d.doc_id, d.chunk_idx, d.idx, w.pos, d.n_total
        FROM walk w JOIN dense d ON w.idx = d.idx WHERE w.pos < d.n_total),
{after}"""


_PERMUTED_COLS = _PLAN_COLS.replace("pos, doc_id", "pos, idx, doc_id")


@register("permuted_plan", sql=f"""
WITH {_permuted_sql()}
SELECT {_PERMUTED_COLS} FROM pl""")
def permuted_plan(spark, sf_dir):
    """E1 + E6 by permutation: the two-epoch, four-rank plan with one shuffle, for the index."""
    return P.permuted_plan(sample_keys(spark, sf_dir), KEYS, EPOCHS, WORLD, BATCH, ACCUM, SEED)


@register("permuted_resume", sql=f"""
WITH {_permuted_sql(epochs=3)}
SELECT {_PERMUTED_COLS} FROM pl
WHERE epoch > {RESUME_EPOCH - 1}
   OR (epoch = {RESUME_EPOCH - 1} AND batch_idx >= ({RESUME_STEP} % steps_per_epoch) * {ACCUM})""")
def permuted_resume(spark, sf_dir):
    """F8 by permutation: what is left of three epochs after step 7, from the step number;
    the samples join by index."""
    indexed = dense_index(sample_keys(spark, sf_dir), KEYS, out="idx", total=None)
    left = P.resume_places(spark, indexed.count(), RESUME_EPOCH, RESUME_STEP, 3, WORLD, BATCH, ACCUM, SEED)
    return left.join(indexed, "idx").select(*[F.col(c.strip()) for c in _PERMUTED_COLS.split(",")])
