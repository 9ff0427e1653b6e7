"""Registered queries: corpus scan, classified table round trips, block sets,
file sizes and size reports. Writes go to fresh folders under the session's
checkpoint dir (the cluster's shared folder)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.functions.text import human_size, thousands
from tokenmill.operators import blocks as B
from tokenmill.operators import classify as C
from tokenmill.queries.block_queries import L, MIN_LEN, STRIDE
from tokenmill.queries.sql_common import CLASSIFIED, CORPUS, blocks_cte, csv, token_ids
from tokenmill.registry import register
from tokenmill.session import scratch_path
from tokenmill.sources import blocksets, classified, corpus, files, fs

LOW_BUCKET = C.bucket_label(0.6, 0.75)


def classified_root(spark, sf_dir) -> str:
    root = scratch_path(spark, "classified")
    classified.write_classified(C.classify(inputs.corpus(spark, sf_dir)), root)
    return root


def _human_size_sql(b: str) -> str:
    idx = "CASE " + " ".join(f"WHEN {b} >= {1024 ** i} THEN {i}" for i in range(6, 0, -1)) + " ELSE 0 END"
    units = "['B','KB','MB','GB','TB','PB','EB','ZB','YB']"
    num, den = f"(CAST({b} AS HUGEINT) * 100)", f"(CAST(1 AS HUGEINT) << (10 * ({idx})))"
    q = f"({num} // {den})"
    r2 = f"(2 * ({num} - {q} * {den}))"
    rounded = f"(CASE WHEN {r2} > {den} THEN {q} + 1 WHEN {r2} < {den} THEN {q} ELSE {q} + {q} % 2 END)"
    return (f"CASE WHEN {b} = 0 THEN '0B' ELSE CAST(CAST({rounded} AS DOUBLE) / 100.0::DOUBLE AS VARCHAR)"
            f" || ' ' || ({units})[({idx}) + 1] END")


def _report_sql(per_source: str) -> str:
    return f"""{per_source},
rep AS (SELECT source, bytes, bytes / CAST(sum(bytes) OVER () AS DOUBLE) * 100.0::DOUBLE AS pct,
               CAST(sum(bytes) OVER () AS BIGINT) AS total FROM per)
SELECT source, bytes, round(pct, 6) AS pct, {_human_size_sql('bytes')} AS size, {_human_size_sql('total')} AS total_size,
       printf('  - %-20s: %-10s (%.2f%%)', source, {_human_size_sql('bytes')}, pct) AS line
FROM rep WHERE bytes > 0"""


def _report_out(df):
    return df.select("source", "bytes", F.round("pct", 6).alias("pct"), "size", "total_size", "line")


@register("corpus_read", sql=f"""
WITH {CORPUS}
SELECT doc_id, source, lang, score, __index__, strlen(text) AS text_bytes FROM corpus""")
def corpus_read(spark, sf_dir):
    """IO1: explicit-schema scan of the corpus split."""
    docs = corpus.read_corpus(spark, f"{sf_dir}/documents.parquet", schema=corpus.DOCUMENTS)
    return inputs.corpus_from_documents(docs).select(
        "doc_id", "source", "lang", "score", "__index__",
        F.octet_length("text").cast("bigint").alias("text_bytes"))


@register("classified_roundtrip", sql=f"""
WITH {CORPUS}, {CLASSIFIED}
SELECT doc_id, source, bucket, score, __index__ FROM classified WHERE bucket = 'score_0.75_to_1.0'""")
def classified_roundtrip(spark, sf_dir):
    """IO2 + IO4 + IO5 + X3: write (source, bucket) leaves, read one band back pruned."""
    root = classified_root(spark, sf_dir)
    return (classified.read_bucket(spark, root, C.HIGH_BUCKET)
            .select("doc_id", "source", "bucket", "score", "__index__"))


@register("skip_existing", sql=f"""
WITH {CORPUS}, {CLASSIFIED}
SELECT source, bucket, count(*) AS n_rows FROM classified WHERE bucket IS NOT NULL GROUP BY source, bucket""")
def skip_existing(spark, sf_dir):
    """IO3: a second write with skip leaves existing leaves alone; every row is there once."""
    root = scratch_path(spark, "classified-skip")
    rows = C.classify(inputs.corpus(spark, sf_dir))
    classified.write_classified(rows.where(F.col("bucket") == LOW_BUCKET), root)
    classified.write_classified(rows, root, on_existing="skip")
    return classified.count_rows(classified.read_classified(spark, root), "source", "bucket")


@register("partition_row_counts", sql=f"""
WITH {CORPUS}, {CLASSIFIED}
SELECT source, bucket, count(*) AS n_rows FROM classified WHERE bucket IS NOT NULL GROUP BY source, bucket""")
def partition_row_counts(spark, sf_dir):
    """IO10: row count per written leaf."""
    root = classified_root(spark, sf_dir)
    return classified.count_rows(classified.read_classified(spark, root), "source", "bucket")


@register("write_counts", sql=f"""
WITH {CORPUS}, {CLASSIFIED}
SELECT source, bucket, count(*) AS n_rows FROM classified GROUP BY source, bucket HAVING bucket IS NOT NULL
UNION ALL SELECT NULL, NULL, count(*) FROM classified WHERE bucket IS NULL
UNION ALL SELECT '(all)', NULL, count(*) FROM classified""")
def write_counts(spark, sf_dir):
    """IO2 + IO10 + Q7: rows per leaf, in no band and in all, from the write itself and the
    footers it leaves; no row is read again."""
    root = scratch_path(spark, "classified-counted")
    _, seen = classified.write_counted(C.classify(inputs.corpus(spark, sf_dir), keep_unbinned=True), root)
    rest = [(None, None, seen["in_no_band"]), ("(all)", None, seen["rows"])]
    return classified.leaf_rows(spark, root).select("source", "bucket", "n_rows").unionByName(
        spark.createDataFrame(rest, "source string, bucket string, n_rows bigint"))


@register("sample_by_index", sql=f"""
WITH {CORPUS}, {CLASSIFIED}, tok AS (SELECT doc_id, {token_ids()} AS ids FROM classified
  WHERE bucket = 'score_0.75_to_1.0'), {blocks_cte('tok', L, STRIDE, MIN_LEN)},
placed AS (SELECT *, row_number() OVER (ORDER BY doc_id, chunk_idx) - 1 AS pos, count(*) OVER () AS n FROM blocks)
SELECT pos, {csv('input_ids')} AS input_ids, {csv('attention_mask')} AS attention_mask,
       {csv("list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)")} AS labels
FROM placed WHERE pos % 7 = 3 OR pos = n - 1""")
def sample_by_index(spark, sf_dir):
    """2.12: every seventh sample and the last of a stored block set by index, with labels."""
    from tokenmill.queries.block_queries import high_blocks
    path = scratch_path(spark, "indexed-blocks")
    n = blocksets.write_indexed(high_blocks(spark, sf_dir), path, ["doc_id", "chunk_idx"], rows_per_slice=64)
    wanted = spark.range(3, n, 7).withColumnRenamed("id", "pos")
    last = spark.createDataFrame([(-1,)] if (n - 1) % 7 != 3 else [], "pos bigint")
    got = blocksets.sample_at(spark, path, wanted.unionByName(last), pad_id=B.PAD_ID)
    return got.select("pos", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask", "labels")])


_BANDS_TOK = (f"{CORPUS}, {CLASSIFIED}, tok AS (SELECT doc_id, {token_ids()} AS ids FROM classified "
              "WHERE bucket IS NOT NULL)")


@register("block_sets_union", sql=f"""
WITH {_BANDS_TOK}, {blocks_cte('tok', L, STRIDE, MIN_LEN)}
SELECT doc_id, chunk_idx, CAST(list_sum(attention_mask) AS BIGINT) AS n_real FROM blocks""")
def block_sets_union(spark, sf_dir):
    """IO6 + U2: one block set per band saved as sub-directories (plus one that is not
    a data set), loaded back as one table; the bad child is skipped."""
    parent = scratch_path(spark, "blocksets")
    rows = C.classify(inputs.corpus(spark, sf_dir))
    for band in (LOW_BUCKET, C.HIGH_BUCKET):
        blk = B.build_blocks(rows.where(F.col("bucket") == band), "text", L, STRIDE, MIN_LEN)
        blocksets.write_blocks(blk, f"{parent}/set_{band}")
    fs.mkdirs(spark, f"{parent}/not_a_dataset")
    got = blocksets.read_block_sets(spark, parent)
    return got.select("doc_id", "chunk_idx",
                      F.aggregate("attention_mask", F.lit(0).cast("bigint"),
                                  lambda a, x: a + x.cast("bigint")).alias("n_real"))


@register("block_set_single", sql=f"""
WITH {CORPUS}, {CLASSIFIED}, tok AS (SELECT doc_id, {token_ids()} AS ids FROM classified
  WHERE bucket = 'score_0.75_to_1.0'), {blocks_cte('tok', L, STRIDE, MIN_LEN)}
SELECT doc_id, chunk_idx, {csv('input_ids')} AS input_ids, {csv('attention_mask')} AS attention_mask FROM blocks""")
def block_set_single(spark, sf_dir):
    """IO7 + IO8: save one block set, load it back by its own path."""
    from tokenmill.queries.block_queries import high_blocks
    path = blocksets.write_blocks(high_blocks(spark, sf_dir), scratch_path(spark, "blocks"))
    got = blocksets.read_block_sets(spark, path, single=True)
    return got.select("doc_id", "chunk_idx", F.array_join("input_ids", ",").alias("input_ids"),
                      F.array_join("attention_mask", ",").alias("attention_mask"))


def text_root(spark, sf_dir) -> str:
    """The classified texts as plain text leaves: a leaf then has one line end per row
    and the texts' own bytes, which SQL can state."""
    root = scratch_path(spark, "classified-text")
    rows = C.classify(inputs.corpus(spark, sf_dir)).select("text", *classified.PARTITION_COLS)
    rows.hint("rebalance", *classified.PARTITION_COLS).write.partitionBy(*classified.PARTITION_COLS).text(root)
    return root


@register("file_sizes", sql=f"""
WITH {CORPUS}, {CLASSIFIED}
SELECT source, bucket, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM classified WHERE bucket IS NOT NULL
GROUP BY source, bucket""")
def file_sizes_q(spark, sf_dir):
    """IO9: bytes on disk of every leaf, from the recursive file listing."""
    sizes = files.file_sizes(spark, text_root(spark, sf_dir))
    leaf = [F.regexp_extract("path", f"/{c}=([^/]*)/", 1).alias(c) for c in classified.PARTITION_COLS]
    return sizes.groupBy(*leaf).agg(F.sum("length").alias("bytes"))


@register("size_report", sql=_report_sql(f"""
WITH {CORPUS}, {CLASSIFIED},
per AS (SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM classified
        WHERE bucket = 'score_0.75_to_1.0' GROUP BY source)"""))
def size_report_q(spark, sf_dir):
    """On-disk bytes per source of the high band, share, human size, report line."""
    return _report_out(files.size_report(spark, text_root(spark, sf_dir), C.HIGH_BUCKET))


@register("corpus_to_labels", sql=f"""
WITH {CORPUS}, {CLASSIFIED}, tok AS (SELECT doc_id, {token_ids()} AS ids FROM classified
  WHERE bucket = 'score_0.75_to_1.0'), {blocks_cte('tok', B.MAX_LENGTH, B.STRIDE, B.MIN_CHUNK_LENGTH)}
SELECT doc_id, chunk_idx, md5({csv('input_ids')}) AS ids_md5, CAST(list_sum(attention_mask) AS BIGINT) AS n_real,
       md5({csv("list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END)")}) AS labels_md5
FROM blocks""")
def corpus_to_labels(spark, sf_dir):
    """The whole chain at the reference's window sizes: write leaves, read one band,
    tokenize and cut, save the block set, load the sets, derive labels."""
    high = classified.read_bucket(spark, classified_root(spark, sf_dir), C.HIGH_BUCKET)
    parent = scratch_path(spark, "chain")
    blocksets.write_blocks(B.build_blocks(high, "text"), f"{parent}/high")
    rows = B.with_labels(blocksets.read_block_sets(spark, parent), pad_id=B.PAD_ID)
    real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return rows.select("doc_id", "chunk_idx", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), real.alias("n_real"),
                       F.md5(F.array_join("labels", ",")).alias("labels_md5"))


@register("text_bytes_report", sql=_report_sql(f"""
WITH {CORPUS}, {CLASSIFIED},
per AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM classified
        WHERE bucket = 'score_0.75_to_1.0' GROUP BY source)"""))
def text_bytes_report(spark, sf_dir):
    """G2 twin + O1: UTF-8 text bytes per source of the high band, largest first."""
    high = C.classify(inputs.corpus(spark, sf_dir)).where(F.col("bucket") == C.HIGH_BUCKET)
    return _report_out(files.text_bytes_report(high))


@register("human_sizes", sql=f"""
SELECT doc_id, strlen(text) AS n_bytes, {_human_size_sql('strlen(text)')} AS size FROM documents""")
def human_sizes(spark, sf_dir):
    """Human-readable size of every document's text."""
    docs = inputs.table(spark, sf_dir, "documents")
    b = F.octet_length("text").cast("bigint")
    return docs.select("doc_id", b.alias("n_bytes"), human_size(b).alias("size"))


@register("report_lines", sql=_report_sql("""
WITH per AS (SELECT source, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source)"""))
def report_lines(spark, sf_dir):
    """One report line per source over the whole corpus."""
    return _report_out(files.text_bytes_report(inputs.table(spark, sf_dir, "documents")))


@register("thousands", sql="""
SELECT source, format('{:,}', count(*)) AS n_rows, format('{:,}', CAST(sum(strlen(text)) AS BIGINT)) AS n_bytes
FROM documents GROUP BY source""")
def thousands_q(spark, sf_dir):
    """Counts with thousands separators."""
    docs = inputs.table(spark, sf_dir, "documents")
    agg = docs.groupBy("source").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("text")).alias("b"))
    return agg.select("source", thousands("c").alias("n_rows"), thousands("b").alias("n_bytes"))

