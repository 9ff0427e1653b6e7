"""Registered queries: classification, filters, union, source statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tokenmill import inputs
from tokenmill.operators import classify as C
from tokenmill.queries.sql_common import CLASSIFIED, CORPUS
from tokenmill.registry import register

PROBE_SOURCE = "src3"


@register("score_bucket_counts", sql=f"""
WITH {CORPUS}, {CLASSIFIED}
SELECT source, bucket, count(*) AS n_rows FROM classified WHERE bucket IS NOT NULL GROUP BY source, bucket""")
def score_bucket_counts(spark, sf_dir):
    """rows per (source, score band); rows in no band are dropped."""
    return (C.classify(inputs.corpus(spark, sf_dir))
            .groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n_rows")))


@register("high_score_union", sql=f"""
WITH {CORPUS}, {CLASSIFIED}
SELECT doc_id, source, score, bucket, text FROM classified WHERE bucket = 'score_0.75_to_1.0'""")
def high_score_union(spark, sf_dir):
    """All high-band rows of every source as one table (one pass, not S filters + union)."""
    return (C.classify(inputs.corpus(spark, sf_dir)).where(F.col("bucket") == C.HIGH_BUCKET)
            .select("doc_id", "source", "score", "bucket", "text"))


@register("source_filter", sql=f"""
WITH {CORPUS}
SELECT doc_id, source, score FROM corpus WHERE source IS NOT DISTINCT FROM '{PROBE_SOURCE}'""")
def source_filter(spark, sf_dir):
    """null-safe equality filter on source."""
    return C.filter_source(inputs.corpus(spark, sf_dir), PROBE_SOURCE).select("doc_id", "source", "score")


@register("score_half_open", sql=f"""
WITH {CORPUS}
SELECT doc_id, source, score FROM corpus WHERE score >= 0.6::DOUBLE AND score < 0.75::DOUBLE""")
def score_half_open(spark, sf_dir):
    """F2: ``0.6 <= score < 0.75``."""
    return C.filter_score(inputs.corpus(spark, sf_dir), 0.6, 0.75).select("doc_id", "source", "score")


@register("score_closed", sql=f"""
WITH {CORPUS}
SELECT doc_id, source, score FROM corpus WHERE score >= 0.75::DOUBLE AND score <= 1.0::DOUBLE""")
def score_closed(spark, sf_dir):
    """last bin, closed: ``0.75 <= score <= 1.0``."""
    return (C.filter_score(inputs.corpus(spark, sf_dir), 0.75, 1.0, closed=True)
            .select("doc_id", "source", "score"))


@register("distinct_sources", sql="SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf_dir):
    """G1: distinct source values."""
    return C.distinct_sources(inputs.table(spark, sf_dir, "documents"))


@register("source_distribution", sql="""
SELECT source, n_rows, round(pct, 6) AS pct,
       printf('  - %-20s: %10s (%.2f%%)', coalesce(source, 'None'), format('{:,}', n_rows), pct) AS line
FROM (SELECT source, n_rows, n_rows / CAST(sum(n_rows) OVER () AS DOUBLE) * 100.0::DOUBLE AS pct
      FROM (SELECT source, count(*) AS n_rows FROM documents GROUP BY source))""")
def source_distribution(spark, sf_dir):
    """Rows per source, share in percent and the report line, largest first."""
    return (C.source_distribution(inputs.table(spark, sf_dir, "documents"))
            .select("source", F.col("rows").alias("n_rows"), F.round("pct", 6).alias("pct"), "line"))


@register("unbinned_counts", sql=f"""
WITH {CORPUS}, {CLASSIFIED}
SELECT source, count(*) AS dropped FROM classified WHERE bucket IS NULL GROUP BY source""")
def unbinned_counts(spark, sf_dir):
    """Q7: rows per source that fall in no band (dropped by F4)."""
    return C.dropped_by_classify(inputs.corpus(spark, sf_dir))
