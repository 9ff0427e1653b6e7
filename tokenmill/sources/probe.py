"""Probing saved tables: one distributed job lists directories and reads Parquet
footers, in place of a Spark job per directory.

Directories are the rows of a table. A task lists its directories; the files found
are dealt out over all tasks, whose threads read only the footers; the result is one
row per directory for the driver, whatever the number of files, and a table of bad
files (the quarantine). Tasks open the store by pyarrow (local folders, and the object
stores and HDFS that it knows). Where tasks can't open it, the same answers come from
Spark's own readers, as one schema merge and one count for all directories together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.session import scratch_path

# Footers that a task reads at a time.
THREADS = 16
# Spark's own schema, as its writer leaves it in a footer (a fixed key of the format).
SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"
# Whether tasks can open a store, by application and store.
_OPENED: dict[tuple[str, str], bool] = {}


@dataclass
class Probe:
    """What is known of one directory. ``error`` names a bad file and why, or says that
    there is no file; a probe without ``error`` can be read as a whole."""

    path: str
    files: int = 0
    rows: int = 0
    bytes: int = 0
    schemas: list[T.StructType] = field(default_factory=list)
    error: str | None = None


def open_store(path: str):
    """``(filesystem, path in it)`` for a fully qualified path, on a worker."""
    from pyarrow import fs as afs
    if re.match(r"(file:)?/", path):
        return afs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    scheme, authority, rest = re.fullmatch(r"([^:]+)://([^/]*)(.*)", path).groups()
    store, base = afs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, base.rstrip("/") + rest


def tasks_can_open(spark: SparkSession, path: str) -> bool:
    """Whether a task can list the store of ``path`` by pyarrow (asked once per store)."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                store, inside = open_store(pdf["path"][0])
                store.get_file_info(inside)
                yield pd.DataFrame({"ok": [True]})
            except Exception:
                yield pd.DataFrame({"ok": [False]})

    key = (spark.sparkContext.applicationId, re.match(r"([^/]*:/*[^/]*)?", path)[0] if "://" in path else "")
    if key not in _OPENED:
        _OPENED[key] = spark.createDataFrame([(path,)], "path string").coalesce(1).mapInPandas(ask, "ok boolean").first()["ok"]
    return _OPENED[key]


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``dir, path, length, error`` of every visible file below each ``dir`` (and one row without
    ``path`` for a directory that has none)."""
    from pyarrow import fs as afs
    for pdf in batches:
        rows = []
        for top in pdf["dir"]:
            try:
                store, inside = open_store(top)
                found = store.get_file_info(afs.FileSelector(inside, recursive=True))
            except Exception as e:
                rows.append((top, None, None, f"{type(e).__name__}: {e}"))
                continue
            below = [(i, i.path[len(inside):].strip("/")) for i in found if i.type == afs.FileType.File]
            seen = [(top, f"{top.rstrip('/')}/{p}", i.size, None) for i, p in below
                    if not any(part.startswith((".", "_")) for part in p.split("/"))]
            rows += seen or [(top, None, None, None)]
        if rows:
            yield pd.DataFrame(rows, columns=["dir", "path", "length", "error"]).astype({"length": "Int64"})


def list_files(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """``dir, path, length, error`` of all files below ``dirs``, listed in tasks."""
    table = spark.createDataFrame([(d,) for d in dirs], "dir string")
    return table.mapInPandas(_listed, "dir string, path string, length bigint, error string")


def _one_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``path, length`` of what lies directly in each ``path``; a directory has no length."""
    from pyarrow import fs as afs
    for pdf in batches:
        for top in pdf["path"]:
            store, inside = open_store(top)
            found = [i for i in store.get_file_info(afs.FileSelector(inside)) if not i.base_name.startswith((".", "_"))]
            if not found:
                continue
            yield pd.DataFrame({"path": [f"{top.rstrip('/')}/{i.base_name}" for i in found],
                                "length": pd.array([i.size if i.type == afs.FileType.File else None for i in found], "Int64")})


def walk(spark: SparkSession, root: str) -> DataFrame:
    """``path, length`` of every visible file below ``root``: each level's directories are
    listed by tasks, so the driver sees one number per level and no name."""
    schema = "path string, length bigint"
    if not tasks_can_open(spark, root):
        return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length"))
    level, files = spark.createDataFrame([(root,)], "path string"), None
    while True:
        out = scratch_path(spark, "listing")
        level.mapInPandas(_one_level, schema).write.parquet(out)
        listed = spark.read.schema(schema).parquet(out)
        own = listed.where("length IS NOT NULL")
        files = own if files is None else files.unionByName(own)
        level = listed.where("length IS NULL").select("path")
        if level.isEmpty():
            return files
        level = level.repartition(spark.sparkContext.defaultParallelism * 4)


def _footer(path: str) -> tuple[int | None, str | None, str | None]:
    """``(rows, schema as Spark's JSON, error)`` of a file, from its footer."""
    import pyarrow.parquet as pq
    from pyspark.sql.pandas.types import from_arrow_schema
    try:
        store, inside = open_store(path)
        with store.open_input_file(inside) as f:
            meta = pq.ParquetFile(f).metadata
        own = (meta.metadata or {}).get(SPARK_SCHEMA)
        schema = own.decode() if own else from_arrow_schema(meta.schema.to_arrow_schema()).json()
        return meta.num_rows, schema, None
    except Exception as e:  # whatever is wrong with it, the caller decides
        return None, None, f"{type(e).__name__}: {(str(e).splitlines() or [''])[0]}"


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with ThreadPoolExecutor(THREADS) as pool:
        for pdf in batches:
            futures = [pool.submit(_footer, p) if isinstance(p, str) else None for p in pdf["path"]]
            got = [(None, None, e) if f is None else f.result() for f, e in zip(futures, pdf["error"])]
            out = pd.DataFrame(got, columns=["n_rows", "schema", "error"])
            yield pd.DataFrame({"dir": pdf["dir"].values, "path": pdf["path"].values, "length": pdf["length"].values,
                                "n_rows": out["n_rows"].astype("Int64"), "schema": out["schema"], "error": out["error"]})


def footers(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """One row per file below ``dirs``: ``dir, path, length, n_rows, schema, error``."""
    schema = "dir string, path string, length bigint, n_rows bigint, schema string, error string"
    files = list_files(spark, dirs).repartition(spark.sparkContext.defaultParallelism * 4)
    return files.mapInPandas(_footers, schema)


def _by_spark(spark: SparkSession, dirs: Sequence[str]) -> list[Probe]:
    """The same through Spark's readers alone, for stores that tasks can't open: files
    that its Parquet reader skips are the bad ones."""
    reader = spark.read.option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(dirs)).select("path", "length")
    schema = reader.option("mergeSchema", "true").parquet(*dirs).schema
    counts = reader.schema(schema).parquet(*dirs).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    out = {d: Probe(d, schemas=[schema], error="no file") for d in dirs}
    for path, length, n in listing.join(counts, "path", "left").collect():
        p = out[max((d for d in dirs if path.startswith(d.rstrip("/") + "/")), key=len)]
        p.error = None if not p.files else p.error
        p.files, p.rows, p.bytes = p.files + 1, p.rows + (n or 0), p.bytes + length
        if n is None:
            p.error = f"{path}: not read as Parquet"
    return list(out.values())


def probe(spark: SparkSession, dirs: Sequence[str], quarantine: str | None = None) -> list[Probe]:
    """One ``Probe`` per directory. ``quarantine``: a folder to which bad files are added
    as a table ``dir, path, length, error``."""
    if not dirs:
        return []
    if not tasks_can_open(spark, dirs[0]):
        return _by_spark(spark, dirs)
    path = scratch_path(spark, "footers")
    footers(spark, dirs).write.parquet(path)  # read twice below, and small
    found = spark.read.parquet(path)
    bad = F.col("error").isNotNull()
    per_dir = found.groupBy("dir").agg(
        F.count("path").alias("files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.sort_array(F.collect_set("schema")).alias("schemas"), F.min(F.when(bad, F.struct("path", "error"))).alias("worst")).collect()
    if quarantine and any(r["worst"] for r in per_dir):
        found.where(bad).select("dir", "path", "length", "error").write.mode("append").parquet(quarantine)
    known: dict[str, T.StructType] = {}
    out = {}
    for r in per_dir:
        schemas = [known.setdefault(s, T.StructType.fromJson(json.loads(s))) for s in r["schemas"]]
        error = f"{r['worst']['path']}: {r['worst']['error']}" if r["worst"] else None if r["files"] else "no file"
        out[r["dir"]] = Probe(r["dir"], r["files"], r["rows"], r["bytes"], schemas, error)
    return [out[d] for d in dirs]


def merged_schema(probes: Sequence[Probe], drop: Sequence[str] = ()) -> T.StructType:
    """Every column of the probes, in the order first met; a column with two types is a
    ``ValueError`` that names both and their directories."""
    fields: dict[str, tuple[T.StructField, str]] = {}
    for p in probes:
        for f in (f for s in p.schemas for f in s.fields if f.name not in drop):
            first, where = fields.setdefault(f.name, (f, p.path))
            if first.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {f.dataType.simpleString()} in {p.path} and "
                                 f"{first.dataType.simpleString()} in {where}")
    return T.StructType([T.StructField(n, f.dataType, True) for n, (f, _) in fields.items()])

