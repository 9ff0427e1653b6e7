"""Whitening by the weighted covariance of distinct vectors.

A vector's entries are taken as integers ``x = floor(1024 * c) + 100000``. Equal ``x``
vectors are grouped first, so a vector that a third of all rows share is fitted and
whitened once. The fit list is every row (``weights="counts"``: a distinct vector
weighs as many rows as it has) or every distinct vector once (``weights="one"``).

1. exact sums ``S`` per dimension, over the distinct vectors and their weights;
2. ``V = sum(m (x - S/n) (x - S/n)^T) / n``: a matrix product of centred rows per task,
   the tasks' products added by Spark; ``n x - S`` is exact before it is divided;
3. unit eigenvectors of ``V`` by falling eigenvalue, of either sign (the entry of the
   largest size is positive), and each distinct vector's projection over ``sqrt(e)``;
4. the rows join their vector's projection on ``x``.

Only sums of fixed size reach the driver: one per dimension and per pair of dimensions.

Rows whose vector is null, or holds a null or non-finite entry, are left out. Repeated
rows each have their result; null keys are kept as they are. An empty table, or one
whose vectors are all left out, gives no rows, and so does a table without variance.
Components whose eigenvalue is not above ``1e-12`` of the largest can't be whitened and
are left out, as are more components than dimensions. Vectors of different lengths are
an error. A ``deviation`` beyond a BIGINT is null. Other columns, whatever their names,
don't matter; the caller's keys come back in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.frames import stored

SCALE, SHIFT = 1024, 100000
COMPONENTS = 8
_FLOOR = 1e-12


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither nulls nor entries that aren't finite."""
    ok = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ok, F.lit(False))


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for batch in batches:
            x, m = _vectors(batch, dim), batch.column("m").to_numpy()
            if not len(x):
                continue
            fits = float(np.abs(x).max()) * float(m.sum()) < 2.0**62
            part = m @ x if fits else m.astype(object) @ x.astype(object)
            total = [a + int(b) for a, b in zip(total, part)]
        if any(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["i", "s"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exact: as 64-bit integers where they fit, else as Python's."""
    if float(np.abs(x).max(initial=0)) * n + float(max(abs(int(s)) for s in sums)) < 2.0**62:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _products(dim: int, n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            d = _centred(_vectors(batch, dim), n, sums).astype(np.float64) / n
            total += (d * batch.column("m").to_numpy()[:, None]).T @ d
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])],
                                         ["i", "j", "v"])

    return run


def _projected(dim: int, n: int, sums: np.ndarray, axes: np.ndarray):
    """``axes``: a column per component, already over the root of its eigenvalue."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _centred(_vectors(batch, dim), n, sums)
            w = (c.astype(np.float64) / n) @ axes
            if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * dim < 2.0**62:
                deviation = (c * c).sum(1).tolist()
            else:
                deviation = [v if v < 2**63 else None for v in (sum(int(e) ** 2 for e in row) for row in c)]
            ends = pa.array(np.arange(len(c) + 1, dtype=np.int32) * axes.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("x"), batch.column("m"), pa.array(deviation, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))], ["x", "m", "deviation", "whitened"])

    return run


def principal_axes(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and their unit eigenvectors as columns."""
    e, axes = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    order = order[e[order] > _FLOOR * max(float(e.max(initial=0)), 0)]
    e, axes = e[order], axes[:, order]
    largest = axes[np.abs(axes).argmax(0), np.arange(len(order))] if len(order) else np.zeros(0)
    return e, axes * np.where(largest < 0, -1.0, 1.0)


def identity_error(done: DataFrame, n: int, components: int) -> float:
    """The largest entry, by size, of the whitened fit list's covariance minus the identity."""
    w = [F.col("whitened")[i] for i in range(components)]
    means = done.agg(*[F.sum(F.col("m") * c) / n for c in w]).first()
    d = [c - F.lit(float(mean)) for c, mean in zip(w, means)]
    at = [(i, j) for i in range(components) for j in range(i, components)]
    cov = done.agg(*[F.sum(F.col("m") * d[i] * d[j]) / n for i, j in at]).first()
    return max(abs(float(c) - (i == j)) for (i, j), c in zip(at, cov))


def whiten(df: DataFrame, keys: Sequence[str], vector: str = "embedding", components: int = COMPONENTS,
           weights: str = "counts") -> DataFrame:
    """One row per row of ``df`` whose vector is finite and per component: the struct
    ``row`` of the ``keys``, ``component`` (from 1), ``n`` (size of the fit list),
    ``deviation`` (``sum((n x - S)^2)``), ``whitened``, ``explained`` (the eigenvalue's
    share of the trace) and ``identity_error``."""
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    c = F.col(vector)
    x = F.transform(c.cast("array<double>"), lambda e: F.floor(e * F.lit(float(SCALE))) + F.lit(SHIFT).cast("bigint"))
    rows = df.where(finite(c)).select(F.struct(*keys).alias("row"), x.alias("x"))
    m = F.count(F.lit(1)) if weights == "counts" else F.lit(1).cast("bigint")
    distinct = stored(rows.groupBy("x").agg(m.alias("m")), "distinct-vectors")
    n, dim, longest = distinct.agg(F.sum("m"), F.min(F.size("x")), F.max(F.size("x"))).first()
    out = f"row {rows.schema['row'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n or not longest:
        return df.sparkSession.createDataFrame([], out)
    if dim != longest:
        raise ValueError(f"vectors of {dim} and of {longest} entries")
    found = distinct.mapInArrow(_sums(dim), "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(dim, object)
    for r in found:
        sums[r["i"]] = int(r["s"])
    products = distinct.mapInArrow(_products(dim, n, sums), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    v = np.zeros((dim, dim))
    for i, j, value in products.collect():  # one row per pair of dimensions
        v[i, j] = v[j, i] = value / n
    e, axes = principal_axes(v, components)
    if not len(e):
        return df.sparkSession.createDataFrame([], out)
    done = stored(distinct.mapInArrow(_projected(dim, n, sums, axes / np.sqrt(e)),
                                      "x array<bigint>, m bigint, deviation bigint, whitened array<double>"), "whitened")
    error = identity_error(done, n, len(e))
    share = F.array(*[F.lit(float(a)) for a in e / np.trace(v)])
    each = rows.join(done.select("x", "deviation", "whitened"), "x").select(
        "row", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("row", (F.col("at") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
                       "whitened", share[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
