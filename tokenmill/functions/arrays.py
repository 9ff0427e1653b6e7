"""Array column functions for token blocks: padding, masks, labels, cut-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions._cols import as_col

IGNORE_INDEX = -100  # label value the loss ignores


def pad_right(ids, length: int, pad_id: int) -> Column:
    """Append ``pad_id`` until the array has ``length`` elements (never truncates)."""
    ids = as_col(ids)
    n_pad = F.greatest(F.lit(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id).cast("bigint"), n_pad))


def attention_mask(n, length: int) -> Column:
    """``n`` ones followed by ``length - n`` zeros, as ``ARRAY<INT>``."""
    n = as_col(n) if not isinstance(n, int) else F.lit(n)
    return F.concat(F.array_repeat(F.lit(1), n),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(length) - n, F.lit(0))))


def labels_from_ids(ids, pad_id: int, mask=None) -> Column:
    """Training labels: a copy of ``ids`` with padding replaced by -100.

    Default (as the reference): every element equal to ``pad_id`` is replaced, so a
    real token with the pad value is ignored too. With ``mask`` given, positions whose
    mask is 0 are replaced instead."""
    ids = as_col(ids)
    if mask is None:
        return F.transform(ids, lambda x: F.when(x == F.lit(pad_id), F.lit(IGNORE_INDEX).cast("bigint"))
                           .otherwise(x))
    return F.zip_with(ids, as_col(mask),
                      lambda x, m: F.when(m == 0, F.lit(IGNORE_INDEX).cast("bigint")).otherwise(x))


def cutoff(ids, length: int) -> Column:
    """Keep at most the first ``length`` elements."""
    return F.slice(as_col(ids), 1, length)


def array_sum(arr) -> Column:
    """Sum of an integer array as BIGINT (0 for empty)."""
    return F.aggregate(as_col(arr), F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))
