from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    """Accept a column name or a Column."""
    return F.col(c) if isinstance(c, str) else c


def idiv(c, k: int) -> Column:
    """Exact floor division of an integer column by a positive int, as BIGINT
    (no trip through a double, so exact for any BIGINT)."""
    c = as_col(c).cast("bigint")
    k_lit = F.lit(k).cast("bigint")
    return F.call_function("div", c - F.pmod(c, k_lit), k_lit)  # an exact multiple of k


def ceil_div(c, k: int) -> Column:
    """Exact ceiling division of a non-negative integer column by a positive int."""
    return idiv(as_col(c).cast("bigint") + F.lit(k - 1).cast("bigint"), k)
