"""Saved block sets (IO6-IO8, U2).

A block set is a Parquet directory of ``(doc_id, chunk_idx, input_ids,
attention_mask)``. ``read_block_sets`` loads every sub-directory of a parent: one
distributed job reads all their footers (``probe``), a child with an unreadable
file is reported and skipped, and all good children are read by ONE scan, which
is the union-all of the sets without a chain of ``union`` nodes.
"""

from __future__ import annotations

import functools
import logging
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.functions._cols import idiv
from tokenmill.operators.blocks import PAD_ID, with_labels
from tokenmill.plans.index import dense_index
from tokenmill.sources import fs
from tokenmill.sources.probe import merged_schema, probe

log = logging.getLogger(__name__)

REQUIRED = ("input_ids", "attention_mask")
DEFAULT_MAX_RECORDS_PER_FILE = 500_000


def write_blocks(df: DataFrame, path: str, mode: str = "errorifexists",
                 max_records_per_file: int = DEFAULT_MAX_RECORDS_PER_FILE) -> str:
    """Save a block set straight from its (narrow) producing stage: no repartition."""
    df.write.option("maxRecordsPerFile", max_records_per_file).mode(mode).parquet(path)
    return path


def read_block_sets(spark: SparkSession, path: str, single: bool = False,
                    columns: tuple[str, ...] | None = None, skipped: list[tuple[str, str]] | None = None,
                    quarantine: str | None = None) -> DataFrame:
    """Load one saved set (``single=True``) or every sub-directory of ``path``.

    A set with a damaged footer in any of its files, without files, or without the
    required columns is left out, logged, and added to ``skipped`` as ``(set, reason)``;
    its bad files are added to the table in the folder ``quarantine``, if one is given.
    A column that some sets lack is null there; one column with two types is a
    ``ValueError``, as is a parent without sub-directory or without a readable one."""
    if single:
        return spark.read.parquet(path)
    if not fs.is_dir(spark, path):
        raise ValueError(f"{path} is not a directory")
    children = fs.child_dirs(spark, path)
    if not children:
        raise ValueError(f"{path} holds no block set: it has no sub-directory")
    good = []
    for p in probe(spark, children, quarantine):
        missing = [c for c in REQUIRED if any(c not in s.fieldNames() for s in p.schemas)]
        reason = p.error or (f"missing columns {missing}" if missing else None)
        if reason is None:
            good.append(p)
            continue
        log.warning("skipping block set %s: %s", p.path, reason)
        if skipped is not None:
            skipped.append((p.path, reason))
    if not good:
        raise ValueError(f"every block set below {path} was unreadable")
    df = spark.read.schema(merged_schema(good)).parquet(*[p.path for p in good])
    return df.select(*columns) if columns else df


# ---- access by sample index (2.12) ---------------------------------------------------

SLICE = "slice"
DEFAULT_ROWS_PER_SLICE = 65_536
# Positions that go into the scan's filter one by one; more are joined.
LISTED = 1_000


def write_indexed(df: DataFrame, path: str, order: Sequence[str], rows_per_slice: int = DEFAULT_ROWS_PER_SLICE) -> int:
    """Save a block set for access by index, and return how many samples it has.

    A row's ``pos`` is its place in ``order`` (a total order; equal rows are
    interchangeable). Rows lie in folders ``slice=<pos div rows_per_slice>``, sorted by
    ``pos`` in each file, so a position names its folder and the row groups' and pages'
    statistics its place there."""
    if rows_per_slice <= 0:
        raise ValueError("rows_per_slice must be positive")
    placed = dense_index(df, list(order), out="pos", total=None)
    placed.withColumn(SLICE, idiv("pos", rows_per_slice)).repartition(SLICE).sortWithinPartitions(SLICE, "pos") \
        .write.partitionBy(SLICE).parquet(path)
    spark = df.sparkSession
    n = spark.read.parquet(path).count()  # from the footers
    spark.createDataFrame([(n, rows_per_slice)], "n bigint, rows_per_slice bigint").coalesce(1) \
        .write.parquet(f"{path.rstrip('/')}/{INDEX}")
    return n


# The table of an indexed set's size, in a folder that readers of the set skip.
INDEX = "_index"


def index_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """``(samples, rows per slice)`` of an indexed set."""
    return tuple(spark.read.schema("n bigint, rows_per_slice bigint").parquet(f"{path.rstrip('/')}/{INDEX}").first())


def sample_at(spark: SparkSession, path: str, positions: Sequence[int] | DataFrame, pad_id: int = PAD_ID,
              by: str = "pad") -> DataFrame:
    """``pos, input_ids, attention_mask, labels`` of the samples at ``positions`` of an indexed
    set, once for each time a position is asked for.

    Negative positions count from the end; one outside the set is an error. A list is put
    into the scan's filter: folders are pruned by ``slice``, row groups and pages by
    ``pos``. A DataFrame (first column: the position), or a list of more than
    ``LISTED``, is joined on ``(slice, pos)``, which prunes folders at run time."""
    n, per_slice = index_size(spark, path)
    data = spark.read.parquet(path)
    if not isinstance(positions, DataFrame):
        asked = [p + n if p < 0 else p for p in positions]
        wrong = [p for p, q in zip(positions, asked) if not 0 <= q < n]
        if wrong:
            raise IndexError(f"no sample {wrong[0]} among {n}")
        if len(asked) <= LISTED:
            listed = [F.col("pos") == F.lit(p) for p in sorted(set(asked))]
            hit = functools.reduce(lambda a, b: a | b, listed) if listed else F.lit(False)
            rows = data.where(F.col(SLICE).isin(sorted({p // per_slice for p in asked})) & hit)
            times = functools.reduce(lambda c, pn: F.when(F.col("pos") == pn[0], pn[1]).otherwise(c),
                                     [pn for pn in Counter(asked).items() if pn[1] > 1], F.lit(1))
            if len(set(asked)) < len(asked):
                rows = rows.select("pos", *REQUIRED, F.explode(F.array_repeat(F.lit(0), times)))
            return with_labels(rows.select("pos", *REQUIRED), pad_id, by)
        positions = spark.createDataFrame([(p,) for p in asked], "pos bigint")
    first = F.col(positions.columns[0]).cast("bigint")
    pos = F.when(first < 0, first + n).otherwise(first)
    inside = F.when((pos >= 0) & (pos < n), pos).otherwise(F.raise_error(F.concat(F.lit("no sample "), first.cast("string"))).cast("bigint"))
    wanted = positions.select(inside.alias("pos")).withColumn(SLICE, idiv("pos", per_slice).cast(data.schema[SLICE].dataType))
    return with_labels(wanted.join(data, [SLICE, "pos"]).select("pos", *REQUIRED), pad_id, by)
