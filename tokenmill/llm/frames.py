"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tokenmill.session import scratch_path

# Most bytes of text one step of a task holds as Python or numpy objects.
CHUNK_BYTES = 8 << 20
# Most bytes of rows that Spark hands a Python worker at a time, unless the session says otherwise
# (by default it is 10,000 rows or 64 MB, held by the JVM and by the worker, for each task).
BATCH_BYTES = 4 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, so
    a lost executor never repeats the work above, and both readers see one result."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``fn`` with freed memory given back to the system after each batch it has taken,
    as the allocators would else keep a worker at its largest batch for good."""
    def run(batches: Batches) -> Batches:
        def taken() -> Batches:
            for batch in batches:
                yield batch
                del batch
                _give_back()

        yield from fn(taken())
        _give_back()

    return run


def map_batches(df: DataFrame, columns: Sequence[str], schema: str,
                fn: Callable[[Batches], Batches]) -> DataFrame:
    """``mapInArrow`` over the named columns only (the scan reads no others). The session's batches
    are held to ``BATCH_BYTES`` from now on, as Spark reads that setting when the plan runs."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, None) is None:
        conf.set(_BATCH_KEY, str(BATCH_BYTES))
    return df.select(*columns).mapInArrow(frugal(fn), schema)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES,
                rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text (and ``rows`` rows) each, or one row."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, int(offsets[start]) + limit, side="right")) - 1
        end = min(max(end, start + 1), n, start + (rows or n))
        yield batch.slice(start, end - start)
        start = end


def free_name(columns: Sequence[str], name: str) -> str:
    """``name``, with as many underscores after it as it takes to be none of ``columns``
    (Spark tells names apart without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
