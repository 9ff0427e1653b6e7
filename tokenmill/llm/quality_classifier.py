"""Quality classifier: supervised subword embeddings.

A text's features are its words and the character n-grams of its words (hashed into
``buckets``), and, with ``REPEAT_WEIGHT``, its three-word windows, marked new or seen
before in the text, and its words that repeat the word before. Each
feature has a learned vector; a text is the average of its features' vectors, and a
softmax layer over it gives the class. Vectors and layer are trained by stochastic
gradient descent in numpy.

Training rows: a sample of at most about ``max_rows`` labelled rows (all of them if
there are fewer), chosen by a hash of key and text; rows equal in both count once, and
their features together are at most ``max_entries``. Only these feature counts reach the
driver. Scoring covers every whole text: after training a feature matters only through
the scalar its vector adds to the log-odds, so a task needs one number per bucket.

Null and empty texts have no features and score by the layer's bias. Labels that are
null, and rows without a label, do not train. If no row trains, every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.frames import free_name, map_batches, stored, text_chunks
from tokenmill.llm.subwords import EXTRA, WordBatch

BUCKETS = 1 << 16
DIMENSION = 16
MAX_ROWS = 3000
# Most features of all training rows together (160 MB on the driver).
MAX_ENTRIES = 20_000_000
EPOCHS = 8
RATE = 1.0
# So many times does a feature of repetition count in the average.
REPEAT_WEIGHT = 16
THRESHOLD = 0.3
# Bytes of text whose words a task holds at a time.
CHUNK = 2 << 20


@dataclass
class Model:
    vectors: np.ndarray  # a row per bucket, then the extra features
    layer: np.ndarray    # a column per class
    bias: np.ndarray

    def weights(self) -> tuple[np.ndarray, float]:
        """What each feature adds to the log-odds of class 1, and the bias."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def train(examples: Sequence[tuple[np.ndarray, np.ndarray, int]], buckets: int = BUCKETS, dimension: int = DIMENSION,
          epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """``examples``: feature ids, their shares (which sum to 1) and the class, 0 or 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimension, 1 / dimension, (buckets + EXTRA, dimension)).astype(np.float32)
    layer, bias = np.zeros((dimension, 2), np.float32), np.zeros(2, np.float32)
    n = len(examples)
    if not n:
        return Model(vectors, layer, bias)
    share = np.clip(np.mean([y for _, _, y in examples]), 1 / (n + 1), n / (n + 1))
    bias[:] = np.log([1 - share, share])
    # a feature's step is scaled by how much of the texts it makes up, as with a gradient
    # of its own scale, so rare n-grams and the most frequent ones learn alike
    squares = np.full(buckets + EXTRA, 1e-6, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(n):
            ids, shares, y = examples[i]
            hidden = shares @ vectors[ids] if len(ids) else np.zeros(dimension, np.float32)
            logit = hidden @ layer + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            if len(ids):
                pull = layer @ p
                size = float(np.abs(pull).max())
                squares[ids] += (shares * size) ** 2
                vectors[ids] -= (step * shares / np.sqrt(squares[ids]))[:, None] * pull * 0.1
                layer -= step * np.outer(hidden, p)
            bias -= step * 0.02 * p
    return Model(vectors, layer, bias)


def _packed(ids: np.ndarray, shares: np.ndarray) -> bytes:
    """A row's features for the way to the driver: ascending ids by their steps, and
    shares, of which few are distinct, take about a fifth of their 8 bytes each."""
    return zlib.compress(np.diff(ids, prepend=np.int32(0)).astype("<i4").tobytes() + shares.astype("<f4").tobytes(), 1)


def _unpacked(features: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = zlib.decompress(features)
    n = len(both) // 8
    return np.cumsum(np.frombuffer(both, "<i4", n), dtype=np.int32), np.frombuffer(both, "<f4", n, 4 * n).copy()


def _examples(buckets: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, "text", CHUNK):
                words = WordBatch(batch.column("text"))
                parts, size = [np.zeros(0, np.int32)], np.zeros(len(words.words), np.int64)
                for begin, end, owner, own in words.feature_blocks(buckets):
                    parts.append(own[np.argsort(owner, kind="stable")].astype(np.int32))
                    size[begin:end] = np.bincount(owner, minlength=end - begin)
                bucket, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])
                repeats = words.repeats() * REPEAT_WEIGHT
                ids, shares = [], []
                begin = 0
                for d, end in enumerate(words.ends.tolist()):
                    word, count = np.unique(words.word[begin:end], return_counts=True)
                    begin = end
                    size = first[word + 1] - first[word]
                    at = np.repeat(first[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    total = np.bincount(bucket[at], np.repeat(count, size), buckets + EXTRA) if len(at) else np.zeros(buckets + EXTRA)
                    total[buckets:] = repeats[d]
                    used = np.flatnonzero(total)
                    ids.append(used.astype(np.int32))
                    shares.append((total[used] / total.sum()).astype(np.float32) if len(used) else np.zeros(0, np.float32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_packed(i, s) for i, s in zip(ids, shares)], pa.binary()), pa.array(list(map(len, ids)), pa.int32()),
                     batch.column("label"), batch.column("place")], ["features", "n", "label", "place"])

    return make


def fit(rows: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", max_rows: int = MAX_ROWS,
        buckets: int = BUCKETS, max_entries: int = MAX_ENTRIES, **how) -> Model:
    """``rows``: labelled texts (labels 0 and 1). Of many, about ``max_rows`` are taken by a
    hash of key and text, and of these as many, in the order of the hash, as have
    ``max_entries`` features together (8 bytes each on the driver, packed on the way there)."""
    rows = rows.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"), F.md5(F.concat_ws(
        ":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.col(text)))).alias("mark")).where("label IN (0, 1)")
    n = rows.count()
    place = F.conv(F.substring("mark", 1, 8), 16, 10).cast("bigint")  # uniform in key and text together
    if n > max_rows:
        rows = rows.where(place < int(2**32 * max_rows / n))
    rows = rows.dropDuplicates(["mark", "label"])  # a row repeated many times is one example
    made = stored(map_batches(rows.withColumn("place", place), ["text", "label", "place"],
                              "features binary, n int, label int, place bigint", _examples(buckets)), "examples")
    sizes = sorted((r["place"], r["n"]) for r in made.select("place", "n").collect())  # about max_rows numbers
    over = [p for (p, _), total in zip(sizes, np.cumsum([s for _, s in sizes])) if total > max_entries]
    table = (made.where(F.col("place") < over[0]) if over else made).toArrow()
    # an order of their own, so that training does not depend on how rows were read
    examples = [(*_unpacked(f.as_py()), y.as_py()) for f, y in zip(table.column("features"), table.column("label"))]
    del table
    examples.sort(key=lambda e: (len(e[0]), e[0].tobytes(), e[1].tobytes(), e[2]))
    return train(examples, buckets, **how)


def score(docs: DataFrame, model: Model, keep: Sequence[str], text: str = "text", out: str = "quality_score") -> DataFrame:
    """The ``keep`` columns and ``out``, the probability of class 1 (replacing a column
    of that name)."""
    keep = [c for c in keep if c != out]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.DoubleType())])
    weights, bias = model.weights()
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float64), bias))  # buckets numbers
    buckets = len(weights) - EXTRA

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for whole in batches:
            for batch in text_chunks(whole, text, CHUNK):
                words = WordBatch(batch.column(text))
                worth, parts = np.zeros(len(words.words)), np.zeros(len(words.words), np.int64)
                for first, end, owner, bucket in words.feature_blocks(buckets):
                    worth[first:end] = np.bincount(owner, w[bucket], end - first)
                    parts[first:end] = np.bincount(owner, minlength=end - first)
                repeats = words.repeats() * REPEAT_WEIGHT
                n = len(words.ends)
                total = np.bincount(words.doc, worth[words.word], n) + repeats @ w[buckets:]
                size = np.bincount(words.doc, parts[words.word], n) + repeats.sum(1)
                logit = total / np.maximum(size, 1) + b
                scores = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], [*keep, out])

    return map_batches(docs, list(dict.fromkeys([*keep, text])), schema, add)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether the key's crc32 (as text) falls in ``part`` of ``parts``; a null key never does."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD,
              **how) -> DataFrame:
    """``docs`` whose score is at least ``threshold``, by a model of the labelled ones
    among them."""
    marked = labels.groupBy(F.col(key).alias("of")).agg(F.max("quality").alias("label"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(marked, F.col("doc_id") == F.col("of"))
    model = fit(rows, **how)
    out = free_name(docs.columns, "quality_score")
    return score(docs, model, docs.columns, text, out).where(F.col(out) >= threshold).select(*docs.columns)
