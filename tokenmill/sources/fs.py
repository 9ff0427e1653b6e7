"""Thin access to the Hadoop FileSystem of the session (metadata only:
existence checks and directory listings; data always goes through Spark)."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme and authority, so that a task knows its store too."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def child_dirs(spark: SparkSession, path: str) -> list[str]:
    """Full paths of the direct sub-directories of ``path`` (hidden ones skipped)."""
    fs, p = _fs(spark, path)
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and not name.startswith((".", "_")):
            out.append(st.getPath().toString())
    return sorted(out)


def glob_dirs(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    found = fs.globStatus(p)
    return sorted(st.getPath().toString() for st in (found or []) if st.isDirectory())


_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._-")
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def plain_partition_value(value) -> str | None:
    """``value`` itself when it needs no path escaping and holds no glob
    character, else None (callers then read the whole root with a filter)."""
    text = None if value is None else str(value)
    return text if text and set(text) <= _PLAIN else None


def unescape_partition_value(value: str):
    """Partition value from a Hive-style directory name (``%XX`` escapes); the
    default-partition marker gives None."""
    if value == DEFAULT_PARTITION:
        return None
    return unquote(value)


def partition_value(path: str, name: str) -> Column:
    """A partition's value from the column ``path``, as the writer escaped it there (a
    reader that infers types would take ``007`` for 7)."""
    raw = F.regexp_extract(path, f"/{name}=([^/]*)(?:/|$)", 1)
    plain = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(raw != DEFAULT_PARTITION, plain).alias(name)
