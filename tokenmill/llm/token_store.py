"""Token ids as raw binary shards with a minimal perfect hash index.

Files of a store (all little-endian):

* ``ids-NNNNN.bin``: the ids of the shard's documents in ascending key order, nothing
  else; 2 bytes an id if the vocabulary allows it, else 4.
* ``ids-NNNNN.rec``: the shard's records: count, count of null keys (which come
  first), token ends (uint64 each), keys (int64 each).
* ``keys-NNNNN.mph``: for the keys whose xxhash64 falls in this part: the levels of a
  minimal perfect hash (a bit array per level; a key's slot is the rank of its bit),
  then per slot a 32-bit fingerprint, the key's first record in the whole store and
  how many records it has.
* ``manifest.json``: id width, records and tokens of each shard, number of parts.

A key is found in constant time: part from its hash, slot from the perfect hash,
fingerprint compared, record number, shard and offset; the record's own key settles
the one in four billion strangers whose fingerprint agrees.

Null keys have records but no index entry. Repeated keys keep all their records.
Null and empty texts are one end id. Shards are range-partitioned on (key, hash of
text), so neither a repeated key nor one shard grows with a hot key. Files are
written under an attempt's own name and then renamed: a task that runs again writes
the same bytes to the same name.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.frames import frugal, map_batches, shuffle_partitions, stored
from tokenmill.llm.tokens import TextEncoder, encoder, tokenizer_path

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
# Bits of the first level of the perfect hash for each key.
GAMMA = 2.0
READ_AT_ONCE = 4 << 20


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store's folder as seen by a task (a shared file system or an object store)."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class _Output:
    """A file that appears under its name when it is whole."""

    def __init__(self, fs: pafs.FileSystem, name: str):
        self.fs, self.name, self.part = fs, name, f"{name}.{uuid.uuid4().hex}.tmp"
        self.out = fs.open_output_stream(self.part)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.name)


# ---- minimal perfect hash -------------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0..n-1. Level i has a bit for every key that no other
    key left at that level meets; the others go on to level i + 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.sizes = [len(bits) * 8 for bits in levels]
        self.ranks, before = [], 0
        for bits in levels:
            ones = np.bitwise_count(bits).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())
        self.n = before

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = GAMMA) -> "PerfectHash":
        levels, rest = [], np.asarray(keys).astype(np.int64).view(np.uint64)
        while len(rest):
            size = max(64, -(-int(gamma * len(rest)) // 64) * 64)
            at = (_mix(rest, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some that are not in it (others get any slot)."""
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, size, rank) in enumerate(zip(self.levels, self.sizes, self.ranks)):
            if not len(rest):
                break
            at = (_mix(keys[rest], level) % np.uint64(size)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (bits[byte] >> bit) & 1 == 1
            below = np.bitwise_count(bits[byte] & ((1 << bit.astype(np.int64)) - 1).astype(np.uint8))
            out[rest[hit]] = (rank[byte] + below)[hit]
            rest = rest[~hit]
        return out


# ---- writing --------------------------------------------------------------------------

def _write_shards(path: str, tokenizer: str, width: int, end_id: int, special_as_text: bool = False):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        fs, folder = filesystem(path)
        enc = encoder(tokenizer, special_as_text)
        kind = np.dtype(f"<u{width}")
        out, sizes, keys = None, [], []
        for batch in batches:
            if out is None:
                out = _Output(fs, f"{folder}/ids-{shard:05d}.bin")
            keys.append(batch.column(0))
            for _, ids, ends in enc.encode(batch.column(1)):
                stop = ends + np.arange(1, len(ends) + 1)
                whole = np.full(int(stop[-1]), end_id, kind)
                inside = np.ones(len(whole), bool)
                inside[stop - 1] = False
                whole[inside] = ids
                out.write(whole.data)
                sizes.append(np.diff(stop, prepend=0))
        if out is None:
            return
        out.close()
        key = pa.chunked_array(keys).combine_chunks()
        ends = np.cumsum(np.concatenate(sizes)).astype("<u8")
        plain = key.drop_null().to_numpy().astype("<i8")  # ascending, nulls first
        rec = _Output(fs, f"{folder}/ids-{shard:05d}.rec")
        for part in (np.array([len(ends), key.null_count], "<u8"), ends, plain):
            rec.write(part.tobytes())
        rec.close()
        distinct, first, count = np.unique(plain, return_index=True, return_counts=True)
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), none, pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1])], pa.int64())],
            ["shard", "key", "first", "n"])
        for i in range(0, len(distinct), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(distinct[part]), shard, np.int32)), pa.array(distinct[part]),
                 pa.array(first[part].astype(np.int64) + key.null_count), pa.array(count[part].astype(np.int64))],
                ["shard", "key", "first", "n"])

    return write


def _write_index(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = filesystem(path)
        part, held = None, []

        def flush():
            key, first, n = (np.concatenate(x) for x in zip(*held))
            hashed = PerfectHash.build(key)
            slot = hashed.slots(key)
            out = _Output(fs, f"{folder}/keys-{part:05d}.mph")
            out.write(np.array([len(key), len(hashed.levels), *map(len, hashed.levels)], "<u8").tobytes())
            for bits in hashed.levels:
                out.write(bits.tobytes())
            for values, kind in ((fingerprint(key), "<u4"), (first, "<u8"), (n, "<u8")):
                ordered = np.empty(len(key), kind)
                ordered[slot] = values
                out.write(ordered.tobytes())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(key)], pa.int64())],
                                              ["part", "n"])

        for batch in batches:
            parts = batch.column(0).to_numpy()
            rows = [batch.column(i).to_numpy() for i in (1, 2, 3)]
            for p in np.unique(parts).tolist():  # rows come sorted by part
                if p != part and held:
                    yield flush()
                    held = []
                part = p
                held.append([r[parts == p] for r in rows])
        if held:
            yield flush()

    return write


def write_store(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                end_id: int = END_ID, n_shards: int | None = None, n_parts: int | None = None,
                special_as_text: bool = False) -> str:
    """Encode ``docs`` and write the store to the shared folder ``path``. A shard's
    task streams its documents; an index part holds the keys of one task (12 bytes
    each), so take ``n_shards`` and ``n_parts`` in proportion to the corpus."""
    spark = docs.sparkSession
    tokenizer = tokenizer or tokenizer_path(TOKENIZER)
    vocab = max(TextEncoder(tokenizer).vocab_size, end_id + 1)
    width = 2 if vocab <= 1 << 16 else 4
    n_shards = n_shards or shuffle_partitions(spark)
    n_parts = n_parts or n_shards
    fs, folder = filesystem(path)
    fs.create_dir(folder, recursive=True)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    order = ["key", F.xxhash64("text")]
    shards = (rows.repartitionByRange(n_shards, *order).sortWithinPartitions(*order)
              .mapInArrow(frugal(_write_shards(path, tokenizer, width, end_id, special_as_text)), "shard int, key bigint, first bigint, n bigint"))
    entries = stored(shards, "token-records")
    written = sorted((r["shard"], r["first"], r["n"]) for r in entries.where("key IS NULL").collect())  # one per shard
    manifest = {"width": width, "parts": n_parts, "shards": [list(x) for x in written]}
    base, bases = 0, []
    for shard, records, _ in written:
        bases.append((shard, base))
        base += records
    starts = spark.createDataFrame(bases, "shard int, base bigint")
    index = (entries.where("key IS NOT NULL").join(F.broadcast(starts), "shard")  # one row per shard
             .groupBy("key").agg(F.min(F.col("base") + F.col("first")).alias("first"), F.sum("n").alias("n"))
             .withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n_parts)).cast("int"))
             .repartition(n_parts, "part").sortWithinPartitions("part")
             .select("part", "key", "first", "n").mapInArrow(_write_index(path), "part int, n bigint"))
    manifest["keys"] = [[r["part"], r["n"]] for r in index.collect()]  # one row per part
    out = _Output(fs, f"{folder}/manifest.json")
    out.write(json.dumps(manifest).encode())
    out.close()
    return path


# ---- reading --------------------------------------------------------------------------

class TokenStore:
    """Keyed access from one process: the manifest, and the parts and records used."""

    def __init__(self, path: str):
        self.fs, self.folder = filesystem(path)
        self.manifest = json.loads(self._bytes("manifest.json"))
        self.kind = np.dtype(f"<u{self.manifest['width']}")
        self.shards = [s for s, _, _ in self.manifest["shards"]]
        self.first_record = np.cumsum([0] + [r for _, r, _ in self.manifest["shards"]])
        self.first_token = np.cumsum([0] + [t for _, _, t in self.manifest["shards"]])
        self.parts = {p for p, _ in self.manifest["keys"]}
        self._part: dict[int, tuple] = {}
        self._rec: dict[int, tuple] = {}

    def _bytes(self, name: str) -> bytes:
        with self.fs.open_input_stream(f"{self.folder}/{name}") as f:
            return f.read()

    def part(self, p: int) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
        if p not in self._part:
            data = self._bytes(f"keys-{p:05d}.mph")
            n, k = (int(x) for x in np.frombuffer(data, "<u8", 2))
            sizes = np.frombuffer(data, "<u8", k, 16).astype(int).tolist()
            at, levels = 16 + 8 * k, []
            for size in sizes:
                levels.append(np.frombuffer(data, np.uint8, size, at))
                at += size
            self._part = {p: (PerfectHash(levels), np.frombuffer(data, "<u4", n, at),
                              np.frombuffer(data, "<u8", n, at + 4 * n), np.frombuffer(data, "<u8", n, at + 12 * n))}
        return self._part[p]

    def records(self, shard_no: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Null keys, token ends and keys of the shard at this place of the manifest."""
        if shard_no not in self._rec:
            data = self._bytes(f"ids-{self.shards[shard_no]:05d}.rec")
            n, nulls = (int(x) for x in np.frombuffer(data, "<u8", 2))
            self._rec = {shard_no: (nulls, np.frombuffer(data, "<u8", n, 16).astype(np.int64),
                                    np.frombuffer(data, "<i8", n - nulls, 16 + 8 * n))}
        return self._rec[shard_no]

    def find(self, p: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of keys of part ``p``; -1 and 0 where
        the fingerprint tells a stranger."""
        if p not in self.parts:
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        hashed, prints, first, n = self.part(p)
        slot = hashed.slots(keys)
        known = (slot >= 0) & (prints[slot] == fingerprint(np.asarray(keys).astype(np.int64).view(np.uint64)))
        return np.where(known, first[slot].astype(np.int64), -1), np.where(known, n[slot].astype(np.int64), 0)

    def ids(self, record: int) -> tuple[int | None, int, np.ndarray]:
        """Key, start and ids of one record."""
        s = int(np.searchsorted(self.first_record, record, side="right")) - 1
        nulls, ends, keys = self.records(s)
        r = record - int(self.first_record[s])
        a, b = (int(ends[r - 1]) if r else 0), int(ends[r])
        with self.fs.open_input_file(f"{self.folder}/ids-{self.shards[s]:05d}.bin") as f:
            f.seek(a * self.kind.itemsize)
            ids = np.frombuffer(f.read((b - a) * self.kind.itemsize), self.kind)
        return (None if r < nulls else int(keys[r - nulls])), int(self.first_token[s]) + a, ids

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document of the key, in the store's order."""
        import struct

        import xxhash
        p = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
        p = (p - (p >> 63 << 64)) % self.manifest["parts"]  # Spark's xxhash64 is signed
        first, n = self.find(p, np.array([key]))
        found = [self.ids(int(first[0]) + i) for i in range(int(n[0]))]
        return [ids for k, _, ids in found if k == key]


def fetch(spark: SparkSession, path: str, keys: DataFrame | None = None, with_ids: bool = False) -> DataFrame:
    """The documents of ``keys`` (a frame whose one column is the key) through the
    index: ``key, start, n_tokens, ids_crc32`` and, if asked for, ``ids``. Without
    ``keys``: the records that have none. Unknown keys give no row. Keys meet their
    index part in one task, and records their shard, in file order."""
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    store = TokenStore(path)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = TokenStore(path)
        for batch in batches:
            parts, wanted = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(parts).tolist():
                own = wanted[parts == p]
                first, n = s.find(p, own)
                record = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                shard = np.searchsorted(s.first_record, record, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.astype(np.int32)), pa.array(record - s.first_record[shard]), pa.array(np.repeat(own, n))],
                    ["shard", "record", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = TokenStore(path)
        for batch in batches:
            shard, record = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            wanted = batch.column(2).to_numpy(zero_copy_only=False)
            for one in np.unique(shard).tolist():
                nulls, ends, keys = s.records(one)
                begin = np.concatenate([[0], ends[:-1]])
                at, ask = record[shard == one], wanted[shard == one]
                real = at >= nulls
                real[real] = keys[at[real] - nulls] == ask[real].astype(np.int64)
                at = at[real | (at < nulls)]
                rows = []
                with s.fs.open_input_file(f"{s.folder}/ids-{s.shards[one]:05d}.bin") as f:
                    i = 0
                    while i < len(at):  # neighbours are read together, up to READ_AT_ONCE ids
                        j = i + 1
                        while j < len(at) and at[j] == at[j - 1] + 1 and ends[at[j]] - begin[at[i]] <= READ_AT_ONCE:
                            j += 1
                        f.seek(int(begin[at[i]]) * s.kind.itemsize)
                        data = np.frombuffer(f.read(int(ends[at[j - 1]] - begin[at[i]]) * s.kind.itemsize), s.kind)
                        for r in at[i:j].tolist():
                            ids = data[begin[r] - begin[at[i]]:ends[r] - begin[at[i]]].astype("<u4")
                            row = (None if r < nulls else int(keys[r - nulls]), int(s.first_token[one] + begin[r]),
                                   len(ids), zlib.crc32(ids))
                            rows.append(row + (ids,) * with_ids)
                        i = j
                cols = list(zip(*rows)) or [()] * (4 + with_ids)
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["key", "start", "n_tokens", "ids_crc32", "ids"][:4 + with_ids])

    if keys is None:
        records = spark.createDataFrame([(i,) for i in range(len(store.shards))], "shard int")

        def nulls_of(batches):
            s = TokenStore(path)
            for batch in batches:
                for one in batch.column(0).to_pylist():
                    n = s.records(one)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, one, np.int32)), pa.array(np.arange(n)),
                                                      pa.nulls(n, pa.int64())], ["shard", "record", "key"])

        found = records.mapInArrow(nulls_of, "shard int, record bigint, key bigint")
    else:
        n_parts = store.manifest["parts"]
        asked = (keys.select(F.col(keys.columns[0]).cast("bigint").alias("key")).where("key IS NOT NULL").distinct()
                 .withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n_parts)).cast("int"))
                 .repartition(n_parts, "part").sortWithinPartitions("part"))
        found = map_batches(asked, ["part", "key"], "shard int, record bigint, key bigint", look_up)
    spread = found.repartitionByRange(max(1, len(store.shards)), "shard", "record")
    return spread.sortWithinPartitions("shard", "record").mapInArrow(frugal(read), schema)
