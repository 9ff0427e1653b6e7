"""The classified corpus as one Hive-partitioned table ``root/source=../bucket=../``.

Write (IO2-IO4): one shuffle that rebalances rows on ``(source, bucket)``; AQE
splits a large (source, bucket) into several tasks and merges small ones, so a
source holding a third of the corpus neither lands in one task nor leaves
thousands of tiny files. Empty leaves never appear (no rows, no directory).

Read (IO5): partition discovery plus a ``bucket = ..`` filter, which Spark turns
into partition pruning: only that band's directories are listed and scanned.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.schemas import require_columns
from tokenmill.sources import fs
from tokenmill.sources.probe import footers, merged_schema, probe

log = logging.getLogger(__name__)

PARTITION_COLS = ("source", "bucket")
DEFAULT_MAX_RECORDS_PER_FILE = 1_000_000
_NULL_KEY = "\u0000null"


def _leaf_key(source, bucket):
    return F.concat_ws("\u0001", F.coalesce(source, F.lit(_NULL_KEY)), bucket)


def existing_leaves(spark: SparkSession, root: str) -> list[tuple[str | None, str]]:
    """``(source, bucket)`` leaves already present under ``root`` (directory listing only)."""
    if not fs.exists(spark, root):
        return []
    out = []
    for leaf in fs.glob_dirs(spark, root.rstrip("/") + "/source=*/bucket=*"):
        parts = leaf.rstrip("/").split("/")
        src = fs.unescape_partition_value(parts[-2].split("=", 1)[1])
        bkt = fs.unescape_partition_value(parts[-1].split("=", 1)[1])
        out.append((src, bkt))
    return out


def write_classified(df: DataFrame, root: str, on_existing: str = "skip",
                     max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE,
                     rebalance: bool = True) -> list[tuple]:
    """Write rows under ``root/source=<s>/bucket=<b>/``; returns the leaves that this
    call added (with ``"append"`` and ``"overwrite"``: all leaves there are afterwards).

    ``on_existing``: ``"skip"`` (the reference's rule: a leaf whose directory
    exists is left alone, even if half written), ``"append"``, ``"overwrite"``
    (dynamic: replaces only the leaves present in ``df``) or ``"error"``.
    With Spark's default (v1) file commit protocol a leaf directory appears only
    when the job commits, so a job that dies mid-way leaves no half-written leaf
    for a re-run to skip; lost tasks are simply retried. Concurrent writers may
    both see a leaf as absent; that race is not handled.

    ``rebalance=True`` (default) shuffles once on ``(source, bucket)`` so file
    counts stay bounded whatever the input layout (AQE splits hot leaves).
    ``rebalance=False`` skips that shuffle and writes from the scan, sorted within
    each task: right for inputs already clustered by source, where each task
    touches few leaves; on mixed inputs it makes tasks x leaves files.
    """
    require_columns(df, *PARTITION_COLS)
    spark = df.sparkSession
    mode = "append"
    done = existing_leaves(spark, root) if on_existing == "skip" else []
    if on_existing == "skip":
        if done:
            keys = [f"{_NULL_KEY if s is None else s}\u0001{b}" for s, b in done]
            df = df.where(~_leaf_key(F.col("source"), F.col("bucket")).isin(keys))
    elif on_existing == "overwrite":
        mode = "overwrite"
    elif on_existing == "error":
        mode = "errorifexists"
    elif on_existing != "append":
        raise ValueError("on_existing must be skip, append, overwrite or error")
    laid_out = (df.hint("rebalance", *PARTITION_COLS) if rebalance
                else df.sortWithinPartitions(*PARTITION_COLS))
    writer = (laid_out.write
              .option("maxRecordsPerFile", max_records_per_file)
              .partitionBy(*PARTITION_COLS).mode(mode))
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(root)
    before = set(done)
    return [leaf for leaf in existing_leaves(spark, root) if leaf not in before]


def write_counted(df: DataFrame, root: str, **how) -> tuple[list[tuple], dict[str, int]]:
    """``write_classified`` for rows that may be in no band (``bucket`` null): these are
    counted and not written. Returns the leaves added and ``rows`` / ``in_no_band``, both
    counted by the writing job itself; ``leaf_rows`` then has each leaf's count."""
    require_columns(df, *PARTITION_COLS)
    seen = Observation(f"classified-{uuid.uuid4().hex}")
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"),
                         F.count_if(F.col("bucket").isNull()).alias("in_no_band"))
    added = write_classified(counted.where(F.col("bucket").isNotNull()), root, **how)
    return added, {k: int(v or 0) for k, v in seen.get.items()}


def read_classified(spark: SparkSession, root: str, data_schema: T.StructType | None = None) -> DataFrame:
    """The whole classified table; partition columns are read as strings. An unreadable
    file is an error (``read_bucket`` can leave out and name unreadable leaves)."""
    if not fs.exists(spark, root):
        raise FileNotFoundError(f"classified root {root} does not exist")
    reader = spark.read.option("basePath", root)
    if data_schema is None:
        merged = reader.option("mergeSchema", "true").parquet(root).schema  # every leaf's columns
        data_schema = T.StructType([f for f in merged.fields if f.name not in PARTITION_COLS])
    schema = T.StructType(list(data_schema.fields) + [T.StructField(c, T.StringType()) for c in PARTITION_COLS])
    return reader.schema(schema).parquet(root)


def band_glob(root: str, bucket: str) -> str | None:
    """Glob of one band's leaf directories, so only these are listed, not the whole
    root; None when the label would need path escaping (then read the root)."""
    plain = fs.plain_partition_value(bucket)
    return None if plain is None else f"{root.rstrip('/')}/source=*/bucket={plain}"


def read_bucket(spark: SparkSession, root: str, bucket: str, data_schema: T.StructType | None = None,
                strict: bool = False, skipped: list[tuple[str, str]] | None = None,
                quarantine: str | None = None) -> DataFrame:
    """One band across every source leaf; sources without it add nothing.

    Only the band's directories are listed, and the band predicate stays as a partition
    filter. One distributed job reads the footers of all leaves: a leaf with an unreadable
    file is left out, logged, and added to ``skipped`` as ``(leaf, reason)`` (its bad files
    to the table in the folder ``quarantine``, if one is given); with ``strict`` it raises
    instead. The result has every column of every leaf, null where a leaf lacks it; a
    column with two types is a ``ValueError``. A band that no source has gives an empty
    result."""
    if not fs.exists(spark, root):
        raise FileNotFoundError(f"classified root {root} does not exist")
    glob = band_glob(root, bucket)
    if glob is None:
        leaves = [leaf for leaf in fs.glob_dirs(spark, root.rstrip("/") + "/source=*/bucket=*")
                  if fs.unescape_partition_value(leaf.rstrip("/").split("bucket=", 1)[1]) == bucket]
    else:
        leaves = fs.glob_dirs(spark, glob)
    good = []
    for p in probe(spark, leaves, quarantine):
        if p.error is None:
            good.append(p)
            continue
        if strict:
            raise ValueError(f"unreadable leaf {p.path}: {p.error}")
        log.warning("skipping leaf %s: %s", p.path, p.error)
        if skipped is not None:
            skipped.append((p.path, p.error))
    data = data_schema or merged_schema(good, drop=PARTITION_COLS)
    full = T.StructType([f for f in data.fields if f.name not in PARTITION_COLS]
                        + [T.StructField(c, T.StringType()) for c in PARTITION_COLS])
    if not good:
        return spark.createDataFrame([], full)
    reader = spark.read.option("basePath", root).schema(full)
    return reader.parquet(*[p.path for p in good]).where(F.col("bucket") == F.lit(bucket))


def leaf_rows(spark: SparkSession, root: str) -> DataFrame:
    """``source, bucket, files, n_rows, bytes`` of every leaf from the footers its writer
    left, so no row is read again."""
    leaves = fs.glob_dirs(spark, root.rstrip("/") + "/source=*/bucket=*") if fs.exists(spark, root) else []
    found = footers(spark, leaves).groupBy("dir").agg(
        F.count("path").alias("files"), F.sum("n_rows").alias("n_rows"), F.sum("length").alias("bytes"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("path", "error"))).alias("bad"))
    read = F.when(F.col("bad").isNull(), F.coalesce("n_rows", F.lit(0))).otherwise(
        F.raise_error(F.concat(F.lit("unreadable file "), F.coalesce("bad.path", "dir"), F.lit(": "), F.col("bad.error"))).cast("bigint"))
    return found.select(*[fs.partition_value("dir", c) for c in PARTITION_COLS], "files", read.alias("n_rows"), "bytes")


def count_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Row count per key (or in total): the per-leaf / per-set counts the reference logs."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"))
