"""File sizes and the per-source size report (IO9, G2, O1).

Directories are listed by tasks, level by level (``probe.walk``), so neither names nor
lengths pass through the driver and no file is opened. The size report of one band
lists that band's directories only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.functions.text import human_size, report_line
from tokenmill.sources import fs
from tokenmill.sources.probe import list_files, tasks_can_open, walk


def file_sizes(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of every (non-hidden) file below ``root``, recursively."""
    return walk(spark, fs.qualified(spark, root))


def leaf_file_sizes(spark: SparkSession, root: str, path: str | None = None) -> DataFrame:
    """``(source, bucket, path, length)`` of the classified table's files (below the
    directories that ``path``, a glob under ``root``, names; default all of it)."""
    dirs = fs.glob_dirs(spark, path) if path else [fs.qualified(spark, root)]
    if path and tasks_can_open(spark, dirs[0]):
        found = list_files(spark, dirs).where("path IS NOT NULL OR error IS NOT NULL")
        found = found.withColumn("length", F.when(F.col("error").isNull(), F.col("length")).otherwise(F.raise_error("error").cast("bigint")))
    elif path:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(dirs)
    else:
        found = walk(spark, dirs[0])
    return found.select(*[fs.partition_value("path", c) for c in ("source", "bucket")], "path", "length")


def share_report(per_source: DataFrame, value: str) -> DataFrame:
    """Add share of the total in percent, human size, the total's human size (the
    report's header line) and the report line; sort by size desc.

    ``per_source`` has one row per source (tiny), so the grand total is a window
    over that grouped result, not over data rows. A zero total gives no rows."""
    w = Window.partitionBy()
    out = (per_source.withColumn("total", F.sum(value).over(w))
           .where(F.col("total") > 0)
           .withColumn("pct", F.col(value) / F.col("total").cast("double") * F.lit(100.0)))
    return (out.withColumn("size", human_size(value))
            .withColumn("total_size", human_size("total"))
            .withColumn("line", report_line(F.coalesce("source", F.lit("None")), value, "pct"))
            .drop("total")
            .orderBy(F.desc(value), F.asc_nulls_first("source")))


def size_report(spark: SparkSession, root: str, bucket: str) -> DataFrame:
    """On-disk bytes per source for one band, share of total, sorted descending."""
    from tokenmill.sources.classified import band_glob
    if not fs.exists(spark, root):
        raise FileNotFoundError(f"classified root {root} does not exist")
    band = band_glob(root, bucket)
    if band is not None and not fs.glob_dirs(spark, band):  # no source has the band: empty report
        return share_report(spark.createDataFrame([], "source string, bytes bigint"), "bytes")
    sizes = leaf_file_sizes(spark, root, band).where(F.col("bucket") == F.lit(bucket))
    per_source = sizes.groupBy("source").agg(F.sum("length").alias("bytes"))
    return share_report(per_source, "bytes")


def text_bytes_report(df: DataFrame, text: str = "text") -> DataFrame:
    """Logical-size twin of ``size_report``: UTF-8 bytes of the text per source."""
    per_source = df.groupBy("source").agg(F.sum(F.octet_length(text)).cast("bigint").alias("bytes"))
    return share_report(per_source, "bytes")
