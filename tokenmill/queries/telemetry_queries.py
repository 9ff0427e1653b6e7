"""Registered queries: step telemetry over the micro-batch log (``events`` fixture)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.functions._cols import idiv
from tokenmill.functions.text import split_words
from tokenmill.functions.training import flops_per_token, mfu
from tokenmill.operators import telemetry as TM
from tokenmill.registry import register

G, B, SEQ, WORLD = 8, 12, 2048, 4
# An example 0.6B-class model spec (parameters of the formula, not data).
N_PARAMS, VOCAB, LAYERS, HIDDEN = 600_000_000, 151_936, 28, 1024
DEVICE = "NVIDIA H800"
DEVICES = ("NVIDIA H800", "NVIDIA GeForce RTX 4090", "Tesla V100-SXM2-32GB", "NVIDIA A100-SXM4-80GB",
           "NVIDIA H100 80GB HBM3", "Tesla T4", "NVIDIA GeForce RTX 3090")
WSD = dict(peak_lr=3.0e-4, min_lr=3.0e-5, warmup_steps=100, decay_steps=500, total_steps=1000)

TOKENS_LOCAL = SEQ * B * G


# The formula as SQL, with its own constants.
FPT_SQL = (f"(6.0::DOUBLE * {N_PARAMS}::DOUBLE * (1.0::DOUBLE + {SEQ}::DOUBLE / (12.0::DOUBLE * {HIDDEN}::DOUBLE)"
           f" + {VOCAB}::DOUBLE / (16.0::DOUBLE * {LAYERS}::DOUBLE * {HIDDEN}::DOUBLE)))")


def closed_steps(spark, sf_dir):
    return TM.step_loss(inputs.micro_log(spark, sf_dir), G)


def steps(spark, sf_dir):
    return TM.with_global_step(closed_steps(spark, sf_dir), inputs.micro_log(spark, sf_dir), grad_accum=G)


def model_flops():
    return flops_per_token(N_PARAMS, SEQ, HIDDEN, VOCAB, LAYERS)


_STEPS_SQL = f"""log AS (SELECT 0 AS epoch, 0 AS rank, event_id AS batch_idx, ts, value AS loss FROM events),
agg AS (SELECT epoch, rank, batch_idx // {G} AS opt_step, sum(loss / {G}) AS loss, count(*) AS micro_batches,
               max(CASE WHEN batch_idx % {G} = {G - 1} THEN 1 END) AS closed,
               min(ts) AS start_ts, max(ts) AS end_ts, max(batch_idx) AS last_batch
        FROM log GROUP BY epoch, rank, opt_step),
st AS (SELECT *, (epoch_us(end_ts) - epoch_us(start_ts)) / 1e6 AS step_time FROM agg WHERE closed IS NOT NULL),
spe AS (SELECT epoch, CAST(floor((max(last_batch) + 1) / {G}) AS BIGINT) AS steps_per_epoch FROM st GROUP BY epoch),
steps AS (SELECT st.*, st.opt_step + 1 AS step, spe.steps_per_epoch,
                 st.epoch * spe.steps_per_epoch + st.opt_step + 1 AS global_step
          FROM st JOIN spe ON st.epoch = spe.epoch)"""


@register("step_loss", sql=f"""
WITH {_STEPS_SQL}
SELECT epoch, rank, opt_step, round(loss, 6) AS loss, micro_batches, step_time FROM steps""")
def step_loss(spark, sf_dir):
    """Loss per optimizer step (sum of loss/G over its micro-batches)."""
    return closed_steps(spark, sf_dir).select("epoch", "rank", "opt_step", F.round("loss", 6).alias("loss"),
                                       "micro_batches", "step_time")


@register("log_every_10", sql=f"""
WITH {_STEPS_SQL}
SELECT epoch, step, global_step, round(loss, 6) AS loss FROM steps WHERE step % 10 = 0""")
def log_every_10(spark, sf_dir):
    """the steps the trainer logs."""
    return TM.log_every(steps(spark, sf_dir), 10).select("epoch", "step", "global_step",
                                                         F.round("loss", 6).alias("loss"))


@register("step_rates", sql=f"""
WITH {_STEPS_SQL}
SELECT epoch, step, global_step,
       CASE WHEN step_time > 0 THEN {float(TOKENS_LOCAL * WORLD)!r}::DOUBLE / step_time ELSE 0.0::DOUBLE END
         AS tokens_per_second,
       CASE WHEN step_time > 0 THEN {float(TOKENS_LOCAL * WORLD)!r}::DOUBLE * {FPT_SQL} / step_time / 1e12
            ELSE 0.0::DOUBLE END AS tflops,
       CASE WHEN step_time <= 0 THEN 0.0::DOUBLE
            ELSE least({float(TOKENS_LOCAL)!r}::DOUBLE * {FPT_SQL} / step_time / 100e12::DOUBLE,
                       1.0::DOUBLE) END * 100.0::DOUBLE AS mfu_percent
FROM steps""")
def step_rates(spark, sf_dir):
    """M5: global tokens/s, effective TFLOPS and MFU per step (H800 -> default peak)."""
    out = TM.step_rates(steps(spark, sf_dir), model_flops(), TM.gpu_peak(F.lit(DEVICE)), WORLD, SEQ, B, G)
    return out.select("epoch", "step", "global_step", "tokens_per_second", "tflops", "mfu_percent")


@register("wsd_schedule", sql=f"""
WITH {_STEPS_SQL}
SELECT global_step,
  CASE WHEN global_step < {WSD['warmup_steps']} THEN {WSD['peak_lr']!r}::DOUBLE * (global_step + 1) / {float(WSD['warmup_steps'])!r}::DOUBLE
       WHEN global_step < {WSD['total_steps'] - WSD['decay_steps']} THEN {WSD['peak_lr']!r}::DOUBLE
       ELSE {WSD['peak_lr']!r}::DOUBLE - ({WSD['peak_lr']!r}::DOUBLE - {WSD['min_lr']!r}::DOUBLE) *
            least(1.0::DOUBLE, greatest(0.0::DOUBLE, (global_step - {float(WSD['total_steps'] - WSD['decay_steps'])!r}::DOUBLE)
                  / {float(WSD['decay_steps'])!r}::DOUBLE)) END AS lr
FROM steps""")
def wsd_schedule(spark, sf_dir):
    """M1: warm-up / stable / decay learning rate after each logged global step."""
    return TM.lr_by_step(steps(spark, sf_dir), **WSD).select("global_step", "lr")


@register("flops_per_token", sql=f"""
WITH words AS (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')) AS w FROM documents),
v AS (SELECT source, count(DISTINCT w) AS vocab FROM words GROUP BY source),
n AS (SELECT source, sum(strlen(text)) AS params, 64 + count(*) AS hidden, 1 + count(DISTINCT lang) AS layers
      FROM documents GROUP BY source),
spec AS (SELECT n.source, n.params, n.hidden, n.layers, CASE WHEN n.params % 3 <> 0 THEN v.vocab END AS vocab
         FROM n LEFT JOIN v ON n.source = v.source)
SELECT source, params::BIGINT AS params, vocab, layers, hidden,
       CASE WHEN vocab IS NULL THEN 6.0::DOUBLE * params::DOUBLE
            ELSE 6.0::DOUBLE * params::DOUBLE * (1.0::DOUBLE + 2048::DOUBLE / (12.0::DOUBLE * hidden::DOUBLE)
                 + vocab::DOUBLE / (16.0::DOUBLE * layers::DOUBLE * hidden::DOUBLE)) END AS flops_per_token
FROM spec""")
def flops_per_token_q(spark, sf_dir):
    """M2: FLOPs per token of a model specification per source, sized by the source's data
    (bytes, distinct words, documents, languages); a third lack the vocabulary (6N)."""
    docs = inputs.table(spark, sf_dir, "documents")
    vocab = (docs.select("source", F.explode(split_words("text")).alias("w")).distinct()
             .groupBy("source").agg(F.count(F.lit(1)).alias("v")))
    spec = docs.groupBy("source").agg(
        F.sum(F.octet_length("text")).cast("bigint").alias("params"), (F.count(F.lit(1)) + 64).alias("hidden"),
        (F.count_distinct("lang") + 1).alias("layers")).join(vocab, "source", "left")
    spec = spec.withColumn("vocab", F.when(F.col("params") % 3 != 0, F.col("v")))
    return spec.select("source", "params", "vocab", "layers", "hidden", flops_per_token(
        "params", 2048, "hidden", "vocab", "layers").alias("flops_per_token"))


@register("step_log", sql=f"""
WITH {_STEPS_SQL},
lr AS (SELECT *, CASE WHEN global_step < 100 THEN 3.0e-4::DOUBLE * (global_step + 1) / 100.0::DOUBLE
                      WHEN global_step < 500 THEN 3.0e-4::DOUBLE
                      ELSE 3.0e-4::DOUBLE - (3.0e-4::DOUBLE - 3.0e-5::DOUBLE) * least(1.0::DOUBLE, greatest(0.0::DOUBLE,
                           (global_step - 500.0::DOUBLE) / 500.0::DOUBLE)) END AS lr FROM steps WHERE step % 10 = 0)
SELECT epoch + 1 AS epoch, 1 AS epochs, step, steps_per_epoch, global_step, round(loss, 6) AS loss, lr,
       CASE WHEN step_time > 0 THEN {SEQ * B * G * WORLD}.0::DOUBLE / step_time ELSE 0.0::DOUBLE END AS tokens_per_second,
       CASE WHEN step_time <= 0 THEN 0.0::DOUBLE
            ELSE least({SEQ * B * G}::DOUBLE * {FPT_SQL} / step_time / 100e12::DOUBLE, 1.0::DOUBLE) END * 100.0::DOUBLE AS mfu_percent,
       step_time,
       CASE WHEN step_time > 0 THEN {SEQ * B * G * WORLD}.0::DOUBLE * {FPT_SQL} / step_time / 1e12::DOUBLE ELSE 0.0::DOUBLE END AS tflops,
       {WORLD} AS gpu_count, {B} AS batch_size, {B * G * WORLD} AS effective_batch_size
FROM lr""")
def step_log_q(spark, sf_dir):
    """The trainer's log record of every tenth step, in one row."""
    out = TM.step_log(steps(spark, sf_dir), model_flops(), TM.gpu_peak(F.lit(DEVICE)), 1, WORLD, SEQ, B, G, **WSD)
    return out.withColumn("loss", F.round("loss", 6))


@register("mfu", sql=f"""
WITH {_STEPS_SQL}
SELECT global_step,
  CASE WHEN step_time <= 0 THEN 0.0::DOUBLE
       ELSE least({float(TOKENS_LOCAL)!r}::DOUBLE * {FPT_SQL} / step_time / 330e12::DOUBLE, 1.0::DOUBLE) END AS mfu,
  CASE WHEN step_time <= 0 THEN 0.0::DOUBLE
       ELSE least({float(TOKENS_LOCAL)!r}::DOUBLE * {FPT_SQL} / step_time / 1.0::DOUBLE, 1.0::DOUBLE) END AS mfu_capped
FROM steps""")
def mfu_q(spark, sf_dir):
    """M3: utilisation on a 4090 peak, and against a peak so low the cap of 1 applies."""
    st = steps(spark, sf_dir)
    return st.select("global_step",
                     mfu(F.lit(TOKENS_LOCAL), F.col("step_time"), model_flops(), F.lit(330e12)).alias("mfu"),
                     mfu(F.lit(TOKENS_LOCAL), F.col("step_time"), model_flops(), F.lit(1.0)).alias("mfu_capped"))


def _device_sql() -> str:
    names = ", ".join(f"'{d}'" for d in DEVICES)
    return f"([{names}])[(global_step % {len(DEVICES)}) + 1]"


# Peak FLOP/s by device, first match wins.
_PEAK_SQL = """CASE WHEN device IS NULL THEN 0.0::DOUBLE WHEN strpos(device, 'V100') > 0 THEN 125e12::DOUBLE
  WHEN strpos(device, 'A100') > 0 THEN 312e12::DOUBLE WHEN strpos(device, 'H100') > 0 THEN 989e12::DOUBLE
  WHEN strpos(device, '3090') > 0 THEN 142e12::DOUBLE WHEN strpos(device, '4090') > 0 THEN 330e12::DOUBLE
  WHEN strpos(device, 'T4') > 0 THEN 130e12::DOUBLE ELSE 100e12::DOUBLE END"""


@register("gpu_peak_lookup", sql=f"""
WITH {_STEPS_SQL}, dev AS (SELECT global_step, {_device_sql()} AS device FROM steps)
SELECT global_step, device, {_PEAK_SQL} AS peak_flops FROM dev""")
def gpu_peak_lookup(spark, sf_dir):
    """M4: peak FLOP/s by the first known key in the device name (default 100e12)."""
    names = F.array(*[F.lit(d) for d in DEVICES])
    dev = steps(spark, sf_dir).select(
        "global_step", F.element_at(names, (F.col("global_step") % len(DEVICES) + 1).cast("int")).alias("device"))
    return dev.withColumn("peak_flops", TM.gpu_peak("device"))


@register("epoch_summary", sql=f"""
WITH {_STEPS_SQL},
pe AS (SELECT epoch, count(*) AS steps, min(start_ts) AS first_ts, max(end_ts) AS last_ts FROM steps GROUP BY epoch),
cum AS (SELECT epoch, steps, (epoch_us(last_ts) - epoch_us(min(first_ts) OVER ())) / 1e6 AS elapsed_seconds,
               CAST(sum(steps * {SEQ * B * G * WORLD}) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total_tokens
        FROM pe)
SELECT epoch, steps, elapsed_seconds, total_tokens,
       CASE WHEN elapsed_seconds > 0 THEN total_tokens / elapsed_seconds ELSE 0.0::DOUBLE END AS avg_tokens_per_second
FROM cum""")
def epoch_summary(spark, sf_dir):
    """Per-epoch run time, tokens so far and mean throughput."""
    return TM.epoch_summary(closed_steps(spark, sf_dir), WORLD, SEQ, B, G)


_SCORES_SQL = """scores AS (
  SELECT 'quality' AS method, d.source AS subject, avg(CAST(l.quality AS DOUBLE)) AS accuracy
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source
  UNION ALL
  SELECT 'toxic' AS method, d.source AS subject, avg(CAST(l.toxic AS DOUBLE)) AS accuracy
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.source)"""


def eval_scores(spark, sf_dir):
    """Per-(method, subject) accuracy table built from ``labels`` x ``documents``:
    subject = source, accuracy = share of positive labels."""
    lab = inputs.table(spark, sf_dir, "labels")
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "source")
    joined = lab.join(docs, "doc_id").select(
        "source", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    long = joined.unpivot(["source"], ["quality", "toxic"], "method", "v")
    return (long.groupBy("method", F.col("source").alias("subject"))
            .agg(F.avg("v").alias("accuracy")))


@register("macro_average", sql=f"""
WITH {_SCORES_SQL}
SELECT a.method, round(a.macro_avg, 6) AS macro_avg, a.subjects, round(b.macro_avg_nonzero, 6) AS macro_avg_nonzero,
       b.subjects_nonzero
FROM (SELECT method, avg(accuracy) AS macro_avg, count(accuracy) AS subjects FROM scores GROUP BY method) a
JOIN (SELECT method, avg(CASE WHEN accuracy > 0 THEN accuracy END) AS macro_avg_nonzero,
             count(CASE WHEN accuracy > 0 THEN accuracy END) AS subjects_nonzero FROM scores GROUP BY method) b
  ON a.method = b.method""")
def macro_average(spark, sf_dir):
    """Macro-average of per-subject accuracy by method, with and without zero scores."""
    scores = eval_scores(spark, sf_dir)
    every = TM.macro_average(scores).withColumn("macro_avg", F.round("macro_avg", 6))
    nonzero = TM.macro_average(scores, drop_zero=True).select(
        "method", F.round("macro_avg", 6).alias("macro_avg_nonzero"), F.col("subjects").alias("subjects_nonzero"))
    return every.join(nonzero, "method")


_PART_KEYS_SQL = """keys AS (
  SELECT key, CAST(sum(p_size) AS DOUBLE) * 1e9 AS flops, max(strlen(key)) * 100 - ascii(key) AS priority
  FROM (SELECT p_size, unnest(string_split(p_name, ' ')) AS key FROM part) GROUP BY key HAVING key < 's')"""


@register("device_peak_join", sql=f"""
WITH {_PART_KEYS_SQL},
best AS (SELECT p_name, arg_min(flops, struct_pack(priority := priority, key := key)) AS flops
         FROM (SELECT DISTINCT p_name FROM part) JOIN keys ON contains(p_name, key) GROUP BY p_name)
SELECT p_partkey, part.p_name AS device, coalesce(best.flops, {TM.GPU_PEAK_DEFAULT!r}::DOUBLE) AS peak_flops
FROM part LEFT JOIN best ON part.p_name = best.p_name""")
def device_peak_join(spark, sf_dir):
    """M4 from a table: device names of a table's rows against a table of keys, the lowest
    priority winning where a name contains several."""
    part = inputs.table(spark, sf_dir, "part")
    words = part.select("p_size", F.explode(F.split("p_name", " ")).alias("key")).where(F.col("key") < "s")
    keys = words.groupBy("key").agg((F.sum("p_size").cast("double") * F.lit(1e9)).alias("flops")).withColumn(
        "priority", F.octet_length("key") * 100 - F.ascii("key"))
    return TM.device_peaks(part.select("p_partkey", F.col("p_name").alias("device")), "device", keys)


RESUME_GAP = 1200


@register("resumed_epoch_summary", sql=f"""
WITH log AS (SELECT event_id % 2 AS rank, event_id // 4096 AS epoch, event_id % 4096 // 2 % 1500 AS batch_idx, ts FROM events),
marked AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY rank, epoch ORDER BY ts)) <= {RESUME_GAP * 10**6} THEN 0 ELSE 1 END AS new
           FROM log),
runs AS (SELECT *, sum(new) OVER (PARTITION BY rank, epoch ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM marked),
sessions AS (SELECT rank, epoch, run, min(ts) AS first, max(ts) AS last FROM runs GROUP BY rank, epoch, run),
times AS (SELECT rank, epoch, count(*) AS runs, CAST(sum(epoch_us(last) - epoch_us(first)) AS BIGINT) AS active_us,
                 (epoch_us(max(last)) - epoch_us(min(first))) / 1e6::DOUBLE AS span FROM sessions GROUP BY rank, epoch),
done AS (SELECT rank, epoch, count(DISTINCT batch_idx) FILTER (batch_idx % {G} = {G - 1}) AS steps,
                count(*) - count(DISTINCT batch_idx) AS repeated FROM log GROUP BY rank, epoch),
so_far AS (SELECT *, active_us / 1e6::DOUBLE AS active_seconds,
                  CAST(sum(steps * {SEQ * B * G * WORLD}) OVER w AS BIGINT) AS total_tokens,
                  CAST(sum(active_us) OVER w AS DOUBLE) / 1e6::DOUBLE AS total_s
           FROM times JOIN done USING (rank, epoch) WINDOW w AS (PARTITION BY rank ORDER BY epoch ROWS UNBOUNDED PRECEDING))
SELECT rank, epoch, runs, active_seconds, span - active_seconds AS pause_seconds, steps, repeated, total_tokens,
       CASE WHEN total_s > 0 THEN total_tokens / total_s ELSE 0.0::DOUBLE END AS avg_tokens_per_second
FROM so_far""")
def resumed_epoch_summary(spark, sf_dir):
    """G6 of a run with pauses and repeated micro-batches, from every event."""
    e = inputs.table(spark, sf_dir, "events")
    at = F.col("event_id") % 4096
    log = e.select((F.col("event_id") % 2).alias("rank"), idiv("event_id", 4096).alias("epoch"), (idiv(at, 2) % 1500).alias("batch_idx"), "ts")
    return TM.resumed_epoch_summary(log, RESUME_GAP, G, WORLD, SEQ, B)
