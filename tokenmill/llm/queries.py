"""The registered queries of this subpackage, and their DuckDB twins where SQL can
express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.llm import (decontaminate, identifiers, language_id, lattice_lm, near_dup, packing,
                           quality_classifier, quality_rules, redirects, sharding, token_store, vector_codes,
                           whitening)
from tokenmill.llm.frames import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 40


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return inputs.table(spark, sf_dir, name)


@register("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    """Weak supervision over all documents: counts, base verdict, votes, posterior, verdict."""
    q = quality_rules.judge(_table(spark, sf_dir, "documents"), ["doc_id"])
    return q.select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept", "votes", "probability")])


@register("op3_language_id")
def op3_language_id(spark, sf_dir):
    """The language of every whole document by the n-gram filter of those not held out."""
    docs = _table(spark, sf_dir, "documents")
    away = quality_classifier.held_out(F.col("doc_id"), 3, 1)
    model = language_id.learn(docs.where(~away))
    return language_id.identify(docs, model, ["doc_id"], out_score="score").select(
        "doc_id", away.alias("held_out"), "lang_pred", "score")


# CRC32 of UTF-8 bytes: the table by its rule, then byte by byte.
_CRC_SQL = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
           lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
crc AS (
  SELECT r, xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
           lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS crc
  FROM docs, crc_table)"""


@register("op6_rendezvous_sharding", sql=f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
{_CRC_SQL},
scored AS (
  SELECT r, doc_id, s, -1.0::DOUBLE / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || s), 1, 12))::BIGINT
           + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) AS score
  FROM docs, (SELECT unnest(range({SHARDS + 1})) AS s)),
best AS (
  SELECT r, arg_max(s, struct_pack(score := score, low := -s)) FILTER (s < {SHARDS}) AS shard,
         arg_max(s, struct_pack(score := score, low := -s)) AS grown_shard
  FROM scored GROUP BY r)
SELECT d.doc_id, coalesce(octet_length(encode(d.text)), 0) + 16 AS size, c.crc AS text_crc32, 'key' AS law,
       CAST(b.shard AS INTEGER) AS shard, CAST(b.grown_shard AS INTEGER) AS grown_shard,
       row_number() OVER (PARTITION BY b.shard ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id,
                          coalesce(octet_length(encode(d.text)), 0), c.crc) - 1 AS slot
FROM docs d JOIN crc c ON d.r = c.r JOIN best b ON d.r = b.r""")
def op6_rendezvous_sharding(spark, sf_dir):
    """Every document in one of 40 equal shards by rendezvous hashing of doc_id."""
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(rows, "doc_id", [1.0] * SHARDS).withColumn("law", F.lit("key"))


_OP7_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@register("op7_decontaminate", sql=f"""
WITH items AS (SELECT item_id::VARCHAR AS item_id, {_OP7_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, ws, least({decontaminate.WINDOW}, len(ws)) AS k FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(ws[i + 1:i + k], ' ') AS w
            FROM (SELECT item_id, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_OP7_WORDS} AS ws FROM documents),
places AS (SELECT r, k, i, array_to_string(ws[i + 1:i + k], ' ') AS w
           FROM (SELECT r, ws, k, unnest(range(len(ws) - k + 1)) AS i
                 FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(ws) >= k)),
hits AS (SELECT p.r, p.i, p.k, w.item_id FROM places p JOIN windows w ON p.k = w.k AND p.w = w.w),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
          FROM hits GROUP BY r)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(w.n_hit, 0)::BIGINT AS n_hit, coalesce(f.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(w.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words w ON d.r = w.r LEFT JOIN found f ON d.r = f.r""")
def op7_decontaminate(spark, sf_dir):
    """Ten-word benchmark windows in every whole document."""
    c = decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), ["doc_id"])
    ids = F.array_sort("contamination.item_ids")
    return c.select("doc_id", "contamination.n_words", "contamination.n_hit",
                    F.size("contamination.item_ids").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
                    decontaminate.contaminated().alias("contaminated"))


@register("op9_pack_sequences")
def op9_pack_sequences(spark, sf_dir):
    """All documents' tokens in sequences of 2048."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@register("op10_token_store")
def op10_token_store(spark, sf_dir):
    """All documents' ids written as a store and read back by key through its index."""
    docs = _table(spark, sf_dir, "documents")
    path = token_store.write_store(docs, scratch_path(spark, "token-store"))
    rows = token_store.fetch(spark, path, docs.select("doc_id")).unionByName(token_store.fetch(spark, path))
    return rows.withColumnRenamed("key", "doc_id")


@register("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    """Quality score of every whole document by subword embeddings learned from the
    labelled documents that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    away = quality_classifier.held_out(F.col("doc_id"), 5, 0)
    labels = _table(spark, sf_dir, "labels").where(~away).groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = quality_classifier.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    scored = quality_classifier.score(docs, model, ["doc_id"], out="score")
    return scored.select("doc_id", away.alias("held_out"), "score",
                         F.when(F.col("score") >= quality_classifier.THRESHOLD, 1).otherwise(0).alias("predicted"))


@register("op5_near_duplicates")
def op5_near_duplicates(spark, sf_dir):
    """One row per document with the class of near duplicates it belongs to."""
    found = near_dup.groups(_table(spark, sf_dir, "documents"))
    same = F.col("key").eqNullSafe(F.col("class_key")) & F.col("t").eqNullSafe(F.col("class_t"))
    return found.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"),
                        same.alias("representative"))


@register("op4_lattice_score")
def op4_lattice_score(spark, sf_dir):
    """Every whole document's log10 probability by the subword lattice, and by words."""
    docs = _table(spark, sf_dir, "documents")
    away = quality_classifier.held_out(F.col("doc_id"), 7, 2)
    return lattice_lm.score(docs, ~away).select(
        "doc_id", quality_classifier.held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score")


RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))

_OP1_RULES = ", ".join(f"('{r}', '{v}')" for r, v in RULES)


# A url with scheme and host in lower case.
_NODE_SQL = ("CASE WHEN strpos({x}, '://') > 0 THEN translate(regexp_extract({x}, '(?s)^.*?://[^/?#]*'), "
             "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || "
             "substr({x}, length(regexp_extract({x}, '(?s)^.*?://[^/?#]*')) + 1) ELSE {x} END")


@register("op1_redirect_filter", sql=rf"""
WITH RECURSIVE rules AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp
                         FROM (VALUES {_OP1_RULES}) t(rule, verdict)),
found AS (
  SELECT DISTINCT url AS u, regexp_replace(url, '^([^:/?#]*://[^/?#]*).*$', '\1', 's') AS site,
         regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '^([^:/?#]*://[^/]*)(/.*/|/)?[^/]*$', '\1\2', 's') AS folder,
         unnest(list_concat(
           regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
           regexp_extract_all(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b', 1),
           regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS t
  FROM pages WHERE url IS NOT NULL AND (contains(lower(html), 'canonical') OR contains(lower(html), 'refresh'))),
targets AS (SELECT *, replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS v FROM found),
absolute AS (SELECT u, CASE WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN v WHEN NOT contains(u, '://') THEN NULL
                            WHEN starts_with(v, '//') THEN split_part(u, '//', 1) || v WHEN starts_with(v, '/') THEN site || v
                            ELSE (CASE WHEN ends_with(folder, '/') THEN folder ELSE folder || '/' END) || v END AS v FROM targets),
links AS (SELECT {_NODE_SQL.format(x='u')} AS u, {_NODE_SQL.format(x='v')} AS v FROM absolute WHERE v IS NOT NULL),
edges AS (SELECT u, v FROM links WHERE u <> v UNION SELECT v, u FROM links WHERE u <> v),
reach AS (SELECT DISTINCT u AS a, u AS b FROM edges UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u),
urls AS (SELECT DISTINCT {_NODE_SQL.format(x='url')} AS url FROM pages UNION SELECT u FROM edges),
rest AS (SELECT url, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^[^?#]*') ELSE '' END AS r
         FROM urls),
parts AS (SELECT url, translate(regexp_extract(coalesce(r, ''), '(?s)^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 substr(coalesce(r, ''), length(regexp_extract(coalesce(r, ''), '(?s)^[^/]*')) + 1) AS path FROM rest),
ruled AS (SELECT p.url, p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.verdict, length(r.rule)) AS verdict
          FROM parts p LEFT JOIN rules r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp)
          GROUP BY ALL),
blocked AS (SELECT DISTINCT reach.a AS url FROM reach JOIN ruled ON reach.b = ruled.url WHERE ruled.verdict = 'block')
SELECT pages.page_id, ruled.host, ruled.path, ruled.rule,
       coalesce(ruled.verdict, CASE WHEN blocked.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN ruled ON {_NODE_SQL.format(x='pages.url')} IS NOT DISTINCT FROM ruled.url LEFT JOIN blocked ON ruled.url = blocked.url""")
def op1_redirect_filter(spark, sf_dir):
    """Every page's url judged by the rules and by its redirect and canonical aliases."""
    pages = _table(spark, sf_dir, "pages")
    judged = redirects.judge(pages, redirects.rule_table(spark, RULES), redirects.canonical_links(pages), ["page_id"])
    return judged.select("page_id", "host", "path", "rule", "verdict")


@register("op11_whiten_vectors")
def op11_whiten_vectors(spark, sf_dir):
    """Every finite embedding on the eight first components of all of them, whitened."""
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"), ["vec_id"])
    return rows.select("row.vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def _op12_sql() -> str:
    k, parts = vector_codes.ENTRIES, vector_codes.PARTS
    steps = [f"""kept AS (SELECT row_number() OVER () AS r, vec_id, label,
  list_transform(embedding, lambda c: CAST(floor(c::DOUBLE * 1024) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
cut AS (SELECT r, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS v FROM kept, range({parts}) t(p)),
first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept QUALIFY e < {k}),
book0 AS (SELECT p, e, v AS b FROM first JOIN cut USING (r))"""]
    for i in range(vector_codes.ROUNDS + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT r, p, min(list_sum(list_transform(list_zip(v, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {k} + e) AS m
  FROM cut JOIN book{i} USING (p) GROUP BY r, p)""")
        if i < vector_codes.ROUNDS:
            steps.append(f"""sums{i} AS (
  SELECT p, m % {k} AS e, j, sum(v[j])::BIGINT AS s, count(*) AS n
  FROM near{i} JOIN cut USING (p, r), LATERAL (SELECT unnest(range(1, len(v) + 1)) AS j) GROUP BY ALL),
moved{i} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS b FROM sums{i} GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(moved{i}.b, book{i}.b) AS b FROM book{i} LEFT JOIN moved{i} USING (p, e))""")
    last = f"near{vector_codes.ROUNDS}"
    steps.append(f"""coded AS (SELECT r, string_agg(lower(printf('%02x', m % {k})), '' ORDER BY p) AS code, sum(m // {k})::BIGINT AS error
  FROM {last} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{vector_codes.ROUNDS})""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), books"""


@register("op12_vector_codes", sql=_op12_sql())
def op12_vector_codes(spark, sf_dir):
    """Every finite embedding's code of four parts, with the errors of its label."""
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"), "vec_id", keep=["label"])
    return vector_codes.group_errors(coded, "label").select(
        "row.vec_id", "code", "error", F.col("group_error").alias("label_error"),
        F.lit(books.sha256()).alias("codebooks_sha256"))


@register("op13_identifiers")
def op13_identifiers(spark, sf_dir):
    """Personal identifiers of every whole document: by pattern, and by the contexts those induce."""
    found = identifiers.extract(_table(spark, sf_dir, "documents"), ["doc_id"])
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in identifiers.KINDS]
    counts = [c.cast("bigint").alias(f"n_{k}") for c, k in zip(counts, identifiers.KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(identifiers.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        identifiers.listed(F.col("spans")).alias("spans"))
