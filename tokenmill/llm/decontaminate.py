"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over
the token windows of every training text.

Words are maximal runs of digits, letters a-z and non-ASCII characters after
lower-casing A-Z. A benchmark item of at least ``window`` words gives all its windows
of that many words; a shorter one (with a word) is one window of its own length. A
document word inside any occurrence of a window is hit.

The scan looks word ids up in the benchmark's vocabulary, hashes the windows that have
only known words, finds them in the sorted window hashes and then compares the ids
themselves, so hash collisions never count. The benchmark's size is counted first: a
set of more than ``BLOCK_WORDS`` words is scanned in blocks of that size, one pass
each, with the same result. Null texts have no words; items without an id or without
words hit nothing; repeated items count once by id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.frames import free_name, map_batches, stored, text_chunks

WINDOW = 10
# Most pairs of window and item broadcast at once (about 300 bytes each).
BLOCK_PAIRS = 500_000
# Upper case to lower case, and every ASCII character that is no word character to a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
                for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("first", T.LongType()),
                                                      T.StructField("last", T.LongType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("clean_text", T.StringType())])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class WindowSet:
    """The windows of some benchmark items, by their length."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items})
        number = {i: n for n, i in enumerate(self.items)}
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[i:i + size]), set()).add(number[item])
        self.by_length = {}
        for size in sorted({len(w) for w in found}):
            windows = np.array([w for w in found if len(w) == size], np.uint64)
            owners = [sorted(found[w]) for w in found if len(w) == size]
            for seed in range(1, 100):
                powers = self._powers(size, seed)
                hashes = self._hash(windows, powers)
                if len(np.unique(hashes)) == len(hashes):
                    break
            order = np.argsort(hashes)
            self.by_length[size] = (powers, hashes[order], windows[order], [owners[i] for i in order])

    @staticmethod
    def _powers(size: int, seed: int) -> np.ndarray:
        rng = np.random.Generator(np.random.Philox(seed))
        return rng.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @staticmethod
    def _hash(windows: np.ndarray, powers: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (windows * powers).sum(axis=1, dtype=np.uint64)
            return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(length, positions, windows)`` of all occurrences in word ids (0: unknown)."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for size, (powers, hashes, windows, _) in self.by_length.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            for part in np.array_split(at, max(1, len(at) * size // 2_000_000)):
                seen = ids[part[:, None] + np.arange(size)].astype(np.uint64)
                h = self._hash(seen, powers)
                w = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                same = np.flatnonzero(hashes[w] == h)
                same = same[(windows[w[same]] == seen[same]).all(axis=1)]
                yield size, part[same], w[same]


def _scan(windows, out: str, schema: T.StructType, text: str, clean: bool, earlier: bool):
    """``earlier``: ``out`` already holds what other blocks have found."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws: WindowSet = windows.value
        get = ws.vocab.get
        for whole in batches:
            for batch in text_chunks(whole, text):
                texts = batch.column(text).to_numpy(zero_copy_only=False).tolist()
                ids, ends = [], []
                for t in texts:
                    ids.extend(map(get, words_of(t), repeat(0)))
                    ends.append(len(ids))
                    ids.append(0)  # keeps windows inside a document
                ids, ends = np.array(ids, np.int64), np.array(ends, np.int64)
                begins = np.concatenate([[0], ends[:-1] + 1])
                cover = np.zeros(len(ids) + 1, np.int32)
                owners: list[set[str]] = [set() for _ in texts]
                for size, at, w in ws.occurrences(ids):
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + size, -1)
                    doc = np.searchsorted(ends, at)
                    for d, k in np.unique(np.stack([doc, w], 1), axis=0).tolist():
                        owners[d].update(ws.items[i] for i in ws.by_length[size][3][k])
                hit = np.cumsum(cover[:-1]) > 0
                before = batch.column(out).to_pylist() if earlier else [None] * len(texts)
                results = []
                for d, t in enumerate(texts):
                    own = hit[begins[d]:ends[d]]
                    if before[d]:
                        own = own.copy()
                        for r in before[d]["ranges"]:
                            own[r["first"]:r["last"] + 1] = True
                        owners[d].update(before[d]["item_ids"])
                    ranges = []
                    if own.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                        ranges = [{"first": a, "last": b - 1} for a, b in edge.reshape(-1, 2).tolist()]
                    results.append({"n_words": len(own), "n_hit": int(own.sum()), "ranges": ranges,
                                    "item_ids": sorted(owners[d]), "clean_text": _without(t, ranges) if clean else None})
                cols = [batch.column(f.name) for f in schema if f.name != out]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(results, _ARROW)], [f.name for f in schema])

    return scan


_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                    ("ranges", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                    ("item_ids", pa.list_(pa.string())), ("clean_text", pa.string())])


def _without(text: str | None, ranges: list[dict]) -> str | None:
    """The text less the hit ranges of words; one space stands for each."""
    if not ranges:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for r in ranges:
        out.append(text[at:places[r["first"]][0]])
        at = places[r["last"]][1]
    return " ".join(out + [text[at:]])


def windows_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The different ``(window, id)`` of the benchmark's items; a window is its words, with
    one space between them."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = benchmark.select(F.col(item).cast("string").alias("id"), F.regexp_extract_all(low, F.lit(_WORD.pattern), F.lit(0)).alias("words"))
    items = items.where("id IS NOT NULL AND size(words) > 0")
    starts = items.select("id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))).alias("i"))
    return starts.select(F.array_join(F.slice("words", F.col("i"), F.lit(window)), " ").alias("window"), "id").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str], text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, out: str = "contamination", clean: bool = False,
         block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """The ``keep`` columns of ``docs`` and the struct ``out`` (replacing a column of
    that name): ``n_words``, ``n_hit``, hit word ``ranges``, sorted ``item_ids`` (as
    strings), and with ``clean`` the text less its hit spans."""
    spark = docs.sparkSession
    pairs = stored(windows_of(benchmark, item, item_text, window), "windows")
    blocks = max(1, -(-pairs.count() // block_pairs))
    keep = [c for c in keep if c != out]
    carried = list(dict.fromkeys([*keep, text]))
    df = docs.select(*carried)
    for i in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("window", "id"), F.lit(blocks)) == i).select("id", "window")
        windows = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in part.collect()], window))  # about block_pairs
        last = i == blocks - 1
        names = keep if last else carried
        schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, RESULT)])
        df = map_batches(df, df.columns, schema, _scan(windows, out, schema, text, clean and last, i > 0))
        if not last:
            df = stored(df, "contamination")
    return df


def contaminated(out: str = "contamination") -> Column:
    return F.col(out)["n_hit"] > 0


def drop_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents that hold a benchmark window."""
    out = free_name(docs.columns, "contamination")
    found = scan(docs, benchmark, docs.columns, out=out, **how)
    return found.where(~contaminated(out)).drop(out)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with the hit spans cut out of ``text``."""
    out = free_name(docs.columns, "contamination")
    found = scan(docs, benchmark, docs.columns, text=text, out=out, clean=True, **how)
    return found.withColumn(text, F.col(out)["clean_text"]).drop(out)
