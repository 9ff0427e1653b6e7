"""String-valued column functions: word split, hashed token ids, size and
report formatting, prompt keys. All built-in expressions, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenmill.functions._cols import as_col

# Fixed values that must equal the reference's output format.
# Unit names of the human-readable size, smallest first.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")
# Prefix of the per-prompt result key (prompt check of the trainer).
PROMPT_KEY_PREFIX = "测试/输入_"
# Report line layout: source padded to 20, size padded to 10, share with 2 decimals.
REPORT_LINE_FORMAT = "  - %-20s: %-10s (%.2f%%)"

# Our own rules (no reference counterpart; the same text runs in the DuckDB twin).
WORD_PATTERN = r"[^ \t\r\n]+"
DEFAULT_ID_SPACE = 50000
DEFAULT_ID_OFFSET = 16  # ids below this are reserved for special tokens (pad = 0)


def split_words(text) -> Column:
    """Whitespace split of ``text`` into an array of words; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(as_col(text), F.lit("")), F.lit(WORD_PATTERN), 0)


def word_count(text) -> Column:
    """Number of words of ``text`` (same rule as ``split_words``), without building
    the word array."""
    return F.regexp_count(F.coalesce(as_col(text), F.lit("")), F.lit(WORD_PATTERN))


def word_id(word: Column, id_space: int = DEFAULT_ID_SPACE, offset: int = DEFAULT_ID_OFFSET,
            hash: str = "md5") -> Column:
    """Stable hashed id of one word, mod ``id_space``, plus ``offset``.

    ``hash="md5"`` (default) takes the first 32 bits of md5: a portable rule that
    other engines reproduce (the DuckDB twins do). ``hash="xxhash64"`` is about 4x
    faster but Spark-specific."""
    if hash == "md5":
        h = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint")
    elif hash == "xxhash64":
        h = F.xxhash64(word)
    else:
        raise ValueError("hash must be 'md5' or 'xxhash64'")
    return F.pmod(h, F.lit(id_space).cast("bigint")) + F.lit(offset).cast("bigint")


def hashed_token_ids(text, id_space: int = DEFAULT_ID_SPACE, offset: int = DEFAULT_ID_OFFSET,
                     hash: str = "md5") -> Column:
    """``ARRAY<BIGINT>`` of hashed word ids for ``text`` (native tokenizer, no shuffle)."""
    return F.transform(split_words(text), lambda w: word_id(w, id_space, offset, hash))


def human_size(nbytes) -> Column:
    """``0B`` for zero, else ``<value rounded to 2> <unit>`` with powers of 1024.

    Thresholds are exact powers of 1024, so there is no float-log edge; a BIGINT
    tops out in the EB range. The value ``b / 1024^i`` is a dyadic rational, so it is
    rounded to 2 decimals in exact integer arithmetic, half to even, which is what
    Python's ``round`` does on it (1152 bytes -> ``1.12 KB``)."""
    b = as_col(nbytes).cast("bigint")
    idx, denom = F.lit(0), F.lit(1).cast("decimal(38,0)")
    for i in range(1, 7):
        idx = F.when(b >= F.lit(1024 ** i), F.lit(i)).otherwise(idx)
        denom = F.when(b >= F.lit(1024 ** i), F.lit(1024 ** i).cast("decimal(38,0)")).otherwise(denom)
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), idx + 1)
    num = b.cast("decimal(38,0)") * F.lit(100).cast("decimal(38,0)")
    q = F.floor(num / denom).cast("bigint")
    twice_r = (num - q.cast("decimal(38,0)") * denom) * F.lit(2).cast("decimal(38,0)")
    rounded = (F.when(twice_r > denom, q + 1).when(twice_r < denom, q)
               .otherwise(q + F.pmod(q, F.lit(2))))
    value = (rounded.cast("double") / F.lit(100.0)).cast("string")
    return F.when(b == 0, F.lit("0B")).otherwise(F.concat(value, F.lit(" "), unit))


def report_line(source, nbytes, pct) -> Column:
    """One line of the per-source size report."""
    return F.format_string(REPORT_LINE_FORMAT, as_col(source), human_size(nbytes), as_col(pct).cast("double"))


def thousands(n) -> Column:
    """Integer with thousands separators, e.g. ``1,234,567``."""
    return F.format_number(as_col(n).cast("bigint"), 0)


def prompt_key(prompt) -> Column:
    """Result key of a prompt: fixed prefix plus its first 10 characters."""
    return F.concat(F.lit(PROMPT_KEY_PREFIX), F.substring(as_col(prompt), 1, 10))
