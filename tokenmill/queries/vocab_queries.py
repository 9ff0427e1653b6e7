"""Registered queries: corpus vocabulary, vocabulary / hook tokenizers, prompt keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.functions.text import PROMPT_KEY_PREFIX, prompt_key
from tokenmill.operators import vocab as V
from tokenmill.queries.sql_common import csv, token_ids
from tokenmill.registry import register

VOCAB_SIZE = 5000

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^ \\t\\r\\n]+')"
_VOCAB_SQL = f"""vocab AS (
  SELECT word, count(*) AS occurrences,
         row_number() OVER (ORDER BY count(*) DESC, word) - 1 + {V.FIRST_WORD_ID} AS id
  FROM (SELECT unnest({_WORDS}) AS word FROM documents) GROUP BY word)"""


@register("vocab_top", sql=f"""WITH {_VOCAB_SQL}
SELECT word, occurrences, id FROM vocab WHERE id < {V.FIRST_WORD_ID + VOCAB_SIZE}""")
def vocab_top(spark, sf_dir):
    """The 5,000 most frequent words of the whole corpus with their ids."""
    return V.build_vocab(inputs.table(spark, sf_dir, "documents"), VOCAB_SIZE)


@register("vocab_token_ids", sql=f"""
WITH {_VOCAB_SQL},
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
      FROM (SELECT doc_id, {_WORDS} AS ws FROM documents)),
t AS (SELECT w.doc_id, count(*) AS n_tokens,
             string_agg(CAST(coalesce(v.id, {V.UNK_ID}) AS VARCHAR), ',' ORDER BY w.i) AS ids_csv
      FROM w LEFT JOIN vocab v ON w.word = v.word GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(t.n_tokens, 0) AS n_tokens, coalesce(t.ids_csv, '') AS ids_csv
FROM documents d LEFT JOIN t ON d.doc_id = t.doc_id""")
def vocab_token_ids(spark, sf_dir):
    """T1(b): every document's words mapped through the whole corpus vocabulary."""
    docs = inputs.table(spark, sf_dir, "documents")
    tok = V.tokenize_with_vocab(docs, V.build_vocab(docs), out="ids")
    return tok.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.array_join("ids", ",").alias("ids_csv"))


@register("hook_token_ids", sql=f"""
WITH tok AS (SELECT doc_id, {token_ids()} AS ids FROM documents)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, {csv('ids')} AS ids_csv FROM tok""")
def hook_token_ids(spark, sf_dir):
    """T1(c): a caller-supplied batch tokenizer run on Arrow batches (here a
    plain-Python twin of the native rule, so it must equal ``token_ids``)."""
    docs = inputs.table(spark, sf_dir, "documents")
    tok = V.tokenize_with(docs, V.hashed_word_tokenizer(), out="ids")
    return tok.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.array_join("ids", ",").alias("ids_csv"))


@register("prompt_keys", sql=f"""
SELECT conv_id, turn, '{PROMPT_KEY_PREFIX}' || substring(text, 1, 10) AS prompt_key
FROM conversations WHERE role = 'user'""")
def prompt_keys(spark, sf_dir):
    """Result key of every user prompt (fixed prefix + first 10 characters)."""
    conv = inputs.chat(spark, sf_dir).where(F.col("role") == "user")
    return conv.select("conv_id", "turn", prompt_key("text").alias("prompt_key"))
