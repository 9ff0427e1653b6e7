"""Source and score-band classification of a scored corpus (one pass).

The reference filters the whole corpus once per source and then once per score
bin per source. Here the band is one ``CASE`` column computed in a single narrow
pass; source and band become partition columns when written (sources.classified),
so later reads prune by directory instead of re-filtering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.schemas import require_columns

# Fixed values of the reference: score bins, the last one closed on the right.
DEFAULT_BINS: tuple[tuple[float, float], ...] = ((0.6, 0.75), (0.75, 1.0))
HIGH_BUCKET = "score_0.75_to_1.0"
# Fixed value: per-source line of the row distribution (source, count with separators, share).
DISTRIBUTION_LINE_FORMAT = "  - %-20s: %10s (%.2f%%)"


def bucket_label(lo: float, hi: float) -> str:
    """Directory-style name of a bin, e.g. ``score_0.75_to_1.0``."""
    return f"score_{float(lo)}_to_{float(hi)}"


def _check_bins(bins: Sequence[tuple[float, float]]) -> None:
    if not bins:
        raise ValueError("at least one score bin is needed")
    for lo, hi in bins:
        if not lo < hi:
            raise ValueError(f"empty bin ({lo}, {hi})")
    for (_, hi0), (lo1, _) in zip(bins, bins[1:]):
        if lo1 < hi0:
            raise ValueError("bins must be sorted and must not overlap")


def score_bucket(score, bins: Sequence[tuple[float, float]] = DEFAULT_BINS) -> Column:
    """Label of the bin holding ``score``: ``lo <= s < hi``, the last bin ``lo <= s <= hi``.

    Null, NaN, and scores outside every bin give null."""
    _check_bins(bins)
    s = F.col(score) if isinstance(score, str) else score
    out = None
    last = len(bins) - 1
    for i, (lo, hi) in enumerate(bins):
        upper = (s <= F.lit(float(hi))) if i == last else (s < F.lit(float(hi)))
        cond = (s >= F.lit(float(lo))) & upper
        label = F.lit(bucket_label(lo, hi))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return F.when(F.isnan(s), F.lit(None).cast("string")).otherwise(out)


def classify(df: DataFrame, bins: Sequence[tuple[float, float]] = DEFAULT_BINS,
             score: str = "score", keep_unbinned: bool = False) -> DataFrame:
    """Add ``bucket``; rows in no bin are dropped unless ``keep_unbinned``."""
    require_columns(df, score)
    out = df.withColumn("bucket", score_bucket(score, bins))
    return out if keep_unbinned else out.where(F.col("bucket").isNotNull())


def filter_source(df: DataFrame, source, col: str = "source") -> DataFrame:
    """Rows of one source; ``None`` selects the null-source group (null-safe equality)."""
    return df.where(F.col(col).eqNullSafe(F.lit(source)))


def filter_score(df: DataFrame, lo: float, hi: float, closed: bool = False,
                 score: str = "score") -> DataFrame:
    """``lo <= score < hi``, or ``lo <= score <= hi`` with ``closed``."""
    s = F.col(score)
    upper = (s <= F.lit(float(hi))) if closed else (s < F.lit(float(hi)))
    return df.where((s >= F.lit(float(lo))) & upper)


def distinct_sources(df: DataFrame, col: str = "source") -> DataFrame:
    """Distinct source values (null kept as its own value)."""
    return df.select(col).distinct()


def source_distribution(df: DataFrame, col: str = "source") -> DataFrame:
    """Rows per source and its share in percent, largest first (ties by source).

    The share divides by a grand total taken from the tiny grouped result, so the
    only shuffle is the partial-aggregated ``groupBy``."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(_whole())
    pct = F.col("rows") / total.cast("double") * F.lit(100.0)
    line = F.format_string(DISTRIBUTION_LINE_FORMAT, F.coalesce(F.col(col).cast("string"), F.lit("None")),
                           F.format_number(F.col("rows"), 0), F.col("pct"))
    return (counts.withColumn("pct", pct).withColumn("line", line)
            .orderBy(F.desc("rows"), F.asc_nulls_first(col)))


def merge_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union-all of per-source slices by column name (row order unspecified)."""
    if not frames:
        raise ValueError("nothing to merge")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def dropped_by_classify(df: DataFrame, bins=DEFAULT_BINS, score: str = "score") -> DataFrame:
    """Rows per source that fall in no bin (the reference drops them silently)."""
    return (df.where(score_bucket(score, bins).isNull())
            .groupBy("source").agg(F.count(F.lit(1)).alias("dropped")))


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy()
