"""Vector codes: k-means codebooks per part of a vector, searched by LAESA pivots.

A vector's entries are taken as integers ``floor(1024 * c)`` and cut into equal
consecutive parts. Each part position has a codebook that starts as that part of the
first vectors by key; each round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and replaces an entry by the
componentwise floor of its parts' mean. All sums are of integers, so the result is
the same however Spark splits the work.

Nearest entries by LAESA: a few entries of the first codebook (farthest-first) are
pivots for good, and the distance of every part to each pivot is computed once and
stored with the part. A round then needs only the distances of pivots to entries:
``|d(part, pivot) - d(pivot, entry)|``, the largest over the pivots, is a lower bound of
the distance. Entries are taken in the order of that bound, in steps, by exact integer
evaluation, and a part is done once the next bound is past its best. Bounds are
lowered by more than their rounding, so pruning never changes a result.

The driver holds the codebooks (parts x entries) and nothing that grows with the
rows; a round sends back one row of sums per entry.

Rows whose vector is null, or holds a null or non-finite entry, are left out. Null keys
come last in the order that starts the codebooks; rows of one key are ordered by their
vector, and equal rows each have their result. With fewer vectors than entries the
codebooks are as short; an empty table gives no rows. Vectors of different lengths, of
a length that the parts don't divide, or with entries beyond 2^27, are errors. The
caller's columns come back in the struct ``row``, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.frames import stored
from tokenmill.llm.whitening import SCALE, finite

PARTS, ENTRIES, ROUNDS = 4, 256, 4
PIVOTS = 8
# Entries that a part evaluates exactly before its bounds are looked at again.
STEP = 8
# Rows that a task searches at a time.
ROWS = 4096
LIMIT = 1 << 27


@dataclass
class Codebooks:
    """``entries[part, entry]``: an entry's integers; ``pivots[part, pivot]`` likewise."""

    entries: np.ndarray
    pivots: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def farthest_first(entries: np.ndarray, count: int) -> np.ndarray:
    """``count`` entries, each the farthest from those before it (ties to the lower index)."""
    chosen, near = [0], ((entries - entries[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((entries - entries[chosen[-1]]) ** 2).sum(1))
    return entries[chosen]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to those of ``b``, rounded to single precision."""
    return np.stack([np.sqrt(((a - row) ** 2).sum(1).astype(np.float64)) for row in b], 1).astype(np.float32)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots_to: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of ``x`` the nearest entry, its squared distance, and how many exact
    distances all of it took. ``to_pivots``: ``distances(x, pivots)``; ``pivots_to``:
    ``distances(pivots, entries)``."""
    n, k = len(x), len(entries)
    bound = np.zeros((n, k), np.float32)
    for p in range(len(pivots_to)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - pivots_to[p]), out=bound)
    bound -= np.float32(4e-7) * (to_pivots.max(initial=0) + pivots_to.max(initial=0))
    np.maximum(bound, 0, out=bound)
    order = np.argsort(bound, 1, kind="stable")
    bound = np.take_along_axis(bound, order, 1).astype(np.float64) ** 2
    best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    open_, evaluated = np.arange(n), 0
    for s in range(0, k, STEP):
        open_ = open_[bound[open_, s] <= best[open_]]
        if not len(open_):
            break
        cols = order[open_, s:s + STEP]
        diff = entries[cols] - x[open_, None, :]
        exact = np.einsum("nkw,nkw->nk", diff, diff)
        evaluated += exact.size
        least = exact.min(1)
        first = np.where(exact == least[:, None], cols, k).min(1)
        better = (least < best[open_]) | ((least == best[open_]) & (first < at[open_]))
        best[open_[better]], at[open_[better]] = least[better], first[better]
    return at, best, evaluated


def _prepared(pivots: np.ndarray):
    """Adds every part's distances to the pivots, once for all rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, count, width = pivots.shape
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, parts, width)
            near = np.stack([distances(x[:, p], pivots[p]) for p in range(parts)], 1)
            rows = pa.array([r.tobytes() for r in near.reshape(len(x), -1)], pa.binary())
            ids = pa.array([r.tobytes() for r in x.reshape(len(x), -1).astype(np.int32)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), ids, rows], ["row", "x", "near"])

    return run


def _searched(batches: Iterator[pa.RecordBatch], books: Codebooks):
    """``(batch, x, at, best)`` of each slice of rows, with a column per part."""
    parts, _, width = books.entries.shape
    between = [distances(books.pivots[p], books.entries[p]) for p in range(parts)]
    for whole in batches:
        for start in range(0, whole.num_rows, ROWS):
            batch = whole.slice(start, ROWS)
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.int32).astype(np.int64).reshape(-1, parts, width)
            near = np.frombuffer(b"".join(batch.column("near").to_pylist()), np.float32).reshape(len(x), parts, -1)
            found = [nearest(x[:, p], near[:, p], books.entries[p], between[p]) for p in range(parts)]
            yield batch, x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _round(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, k, width = books.entries.shape
        sums, counts = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for _, x, at, _ in _searched(batches, books):
            for p in range(parts):
                counts[p] += np.bincount(at[:, p], minlength=k)
                for i in range(width):  # exact: under 2^27 times ROWS
                    sums[p, :, i] += np.bincount(at[:, p], x[:, p, i], k).astype(np.int64)
        part, entry = np.nonzero(counts)
        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]),
             pa.ListArray.from_arrays(ends, pa.array(sums[part, entry].reshape(-1)))], ["part", "entry", "n", "sums"])

    return run


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, at, best in _searched(batches, books):
            codes = pa.array(["".join(f"{i:02x}" for i in row) for row in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), codes, pa.array(best.sum(1))], ["row", "code", "error"])

    return run


def compress(df: DataFrame, key: str, vector: str = "embedding", keep: Sequence[str] = (), parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks]:
    """``(coded, books)``: for every row of ``df`` whose vector is finite the struct
    ``row`` of ``key`` and ``keep``, the ``code`` (two hex digits per part) and the
    ``error`` (squared distances to its entries, over the parts); and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so at most 256 entries")
    names = [key, *(c for c in keep if c != key)]
    x = F.transform(F.col(vector).cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint"))
    rows = df.where(finite(F.col(vector))).select(F.struct(*names).alias("row"), x.alias("x"))
    kind = rows.schema["row"].dataType.simpleString()
    most = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x"))))
    n, dim, longest, most = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), most).first()
    if not n or not longest:
        none = Codebooks(np.zeros((parts, 0, 0), np.int64), np.zeros((parts, 0, 0), np.int64))
        return df.sparkSession.createDataFrame([], f"row {kind}, code string, error bigint"), none
    if dim != longest or dim % parts or most >= LIMIT:
        raise ValueError(f"vectors of {dim} to {longest} entries up to {most}, in {parts} parts")
    first = rows.orderBy(F.col("row")[key].asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2)
    books = Codebooks(start, np.stack([farthest_first(start[p], pivots) for p in range(parts)]))
    table = stored(rows.mapInArrow(_prepared(books.pivots), f"row {kind}, x binary, near binary"), "parts")
    for _ in range(rounds):
        sums = table.mapInArrow(_round(books), "part int, entry int, n bigint, sums array<bigint>")
        sums = sums.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dim // parts)]).alias("sums"))
        moved = books.entries.copy()
        for part, entry, count, total in sums.collect():  # a row per entry in use
            moved[part, entry] = [s // count for s in total]
        books = Codebooks(moved, books.pivots)
    return stored(table.mapInArrow(_coded(books), f"row {kind}, code string, error bigint"), "codes"), books


def group_errors(coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with ``group_error``: the errors summed over the rows of an equal ``label``
    (a field of ``row``), nulls together."""
    mark = F.col("row")[label]
    sums = coded.groupBy(mark.alias("mark")).agg(F.sum("error").alias("group_error"))
    return coded.join(sums, mark.eqNullSafe(F.col("mark"))).select("row", "code", "error", "group_error")
