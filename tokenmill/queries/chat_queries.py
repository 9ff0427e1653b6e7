"""Registered queries: chat rendering, cut-off, packing, caps, hold-out, set
selection and weighted interleave."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.functions.text import hashed_token_ids, split_words
from tokenmill.operators import chat as CH
from tokenmill.queries.sql_common import csv, token_ids
from tokenmill.registry import register

CUTOFF = 512
SHARDS = 16
SEED = 42
CAP_PER_SET = 30
VAL_SIZE = 10
EVAL_SETS = ("src1", "src7")
# The six mixing weights of the reference's fine-tune run.
MIX = {"src0": 0.1, "src1": 0.35, "src2": 0.2, "src3": 0.2, "src4": 0.1, "src5": 0.05}

_RENDER_SQL = """rendered AS (
  SELECT conv_id, count(*) AS turns,
         string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                    ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS prompt
  FROM conversations GROUP BY conv_id)"""


def rendered(spark, sf_dir):
    return CH.render_chat(inputs.chat(spark, sf_dir), add_generation_prompt=True)


@register("chat_render", sql=f"WITH {_RENDER_SQL} SELECT conv_id, prompt, turns FROM rendered")
def chat_render(spark, sf_dir):
    """T4: every conversation rendered with the ChatML template plus generation prompt."""
    return rendered(spark, sf_dir)


@register("cutoff", sql=f"""
WITH {_RENDER_SQL}, tok AS (SELECT conv_id, {token_ids('prompt')} AS ids FROM rendered)
SELECT conv_id, CAST(len(ids) AS BIGINT) AS n_tokens, {csv(f'list_slice(ids, 1, {CUTOFF})')} AS ids_csv
FROM tok""")
def cutoff(spark, sf_dir):
    """Rendered conversations tokenized and cut to 512 tokens."""
    tok = rendered(spark, sf_dir).select("conv_id", hashed_token_ids("prompt").alias("input_ids"))
    cut = CH.cutoff_tokens(tok.withColumn("n_tokens", F.size("input_ids").cast("bigint")), CUTOFF)
    return cut.select("conv_id", "n_tokens", F.array_join("input_ids", ",").alias("ids_csv"))


@register("eval_set_select", sql=f"""
SELECT doc_id, source FROM documents WHERE source IN ({", ".join(f"'{s}'" for s in EVAL_SETS)})""")
def eval_set_select(spark, sf_dir):
    """Only the named evaluation sets."""
    return CH.select_sets(inputs.table(spark, sf_dir, "documents"), EVAL_SETS).select("doc_id", "source")


@register("pack_bins", sql=f"""
WITH RECURSIVE {_RENDER_SQL},
items AS (SELECT conv_id, md5(prompt) AS prompt_md5, least(len(regexp_extract_all(prompt, '[^ \\t\\r\\n]+')), {CUTOFF}) AS length,
                 CAST(('0x' || substr(md5('{SEED}:' || conv_id), 1, 8))::BIGINT % {SHARDS} AS INTEGER) AS shard,
                 md5('{SEED}:' || conv_id) AS k FROM rendered),
s AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY k, conv_id) AS rn FROM items),
r AS (SELECT shard, rn, conv_id, prompt_md5, length, CAST(0 AS BIGINT) AS bin, CAST(length AS BIGINT) AS fill,
             CAST(0 AS BIGINT) AS bin_offset FROM s WHERE rn = 1
      UNION ALL
      SELECT s.shard, s.rn, s.conv_id, s.prompt_md5, s.length,
             CASE WHEN r.fill + s.length > {CUTOFF} THEN r.bin + 1 ELSE r.bin END,
             CASE WHEN r.fill + s.length > {CUTOFF} THEN s.length ELSE r.fill + s.length END,
             CASE WHEN r.fill + s.length > {CUTOFF} THEN 0 ELSE r.fill END
      FROM r JOIN s ON s.shard = r.shard AND s.rn = r.rn + 1)
SELECT conv_id, prompt_md5, shard, CAST(length AS BIGINT) AS length, bin, bin_offset FROM r""")
def pack_bins(spark, sf_dir):
    """T5: next-fit packing of cut conversations into 512-token bins, 16 seeded shards, the
    prompts carried along."""
    items = rendered(spark, sf_dir).select(
        "conv_id", "prompt", F.least(F.size(split_words("prompt")), F.lit(CUTOFF)).cast("bigint").alias("length"))
    packed = CH.pack(items, CUTOFF, ["conv_id"], "length", SHARDS, SEED)
    return packed.select("conv_id", F.md5("prompt").alias("prompt_md5"), "shard", "length", "bin", "bin_offset")


@register("capped_samples", sql=f"""
SELECT doc_id, source, text FROM (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || doc_id), doc_id) AS rn
  FROM documents) WHERE rn <= {CAP_PER_SET}""")
def capped_samples(spark, sf_dir):
    """O2: at most 30 documents per source, the lowest by seeded key."""
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return CH.cap_samples(docs, CAP_PER_SET, ["doc_id"], ["source"], SEED)


@register("train_val_split", sql=f"""
WITH {_RENDER_SQL}
SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || conv_id), conv_id) <= {VAL_SIZE}
                     THEN 'val' ELSE 'train' END AS split
FROM rendered""")
def train_val_split(spark, sf_dir):
    """O3: hold out 10 conversations by seeded key, the rest train."""
    conv = rendered(spark, sf_dir).select("conv_id")
    return CH.train_val_split(conv, VAL_SIZE, ["conv_id"], SEED).select("conv_id", "split")


def _mix_values() -> str:
    return ", ".join(f"('{s}', {p!r}::DOUBLE, {i})" for i, (s, p) in enumerate(MIX.items()))


@register("weighted_interleave", sql=f"""
WITH rows AS (SELECT source, doc_id, md5(text) AS text_md5, md5('{SEED}:' || doc_id) AS k FROM documents
              WHERE source IN ({", ".join(f"'{s}'" for s in MIX)})),
w AS (SELECT * FROM (VALUES {_mix_values()}) t(source, p, set_idx)),
sz AS (SELECT source, count(*) AS n FROM rows GROUP BY source),
tt AS (SELECT max(ceil(n / p)) AS T FROM sz JOIN w ON sz.source = w.source),
m AS (SELECT sz.source, w.p, w.set_idx, sz.n, CAST(ceil(w.p * tt.T) AS BIGINT) AS m
      FROM sz JOIN w ON sz.source = w.source CROSS JOIN tt),
ranked AS (SELECT source, doc_id, text_md5, row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 1 AS j FROM rows),
rep AS (SELECT ranked.source, ranked.doc_id, ranked.text_md5, m.set_idx, m.p,
               ranked.j + unnest(range(0, CAST(ceil((m.m - ranked.j) / m.n) AS BIGINT))) * m.n AS r
        FROM ranked JOIN m ON ranked.source = m.source WHERE ranked.j < m.m)
SELECT source, doc_id, text_md5, r, (r + 0.5::DOUBLE) / p AS order_key,
       row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / p, set_idx) - 1 AS pos
FROM rep""")
def weighted_interleave(spark, sf_dir):
    """Six sources mixed with the fixed weights and oversampling, whole rows, in interleave order."""
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = CH.interleave(docs, MIX, ["doc_id"], "source", over=True, seed=SEED)
    return mixed.select("source", "doc_id", F.md5("text").alias("text_md5"), "r", "order_key", "pos")
