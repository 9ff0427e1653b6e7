"""Vocabulary from the corpus (T7) and the two non-native tokenizer back ends:
a fixed vocabulary (T1b) and a caller-supplied batch function (T1c).

Word counting is a ``groupBy`` with map-side partial aggregation, so a very
frequent word costs one row per map task, not one shuffled row per occurrence.
The vocabulary is the first ``max_size`` words by ``(count desc, word)``, or every
word; ranks are always distributed. T1b looks the most frequent words up in a
broadcast table of bounded size and joins only the others with the vocabulary, so
neither the driver nor a worker ever holds it whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.text import WORD_PATTERN, split_words
from tokenmill.llm.frames import frugal, map_batches, text_chunks
from tokenmill.plans.index import dense_index

# Our special ids (below the first word id).
PAD_ID, UNK_ID, FIRST_WORD_ID = 0, 1, 16
# Words of the vocabulary that are broadcast (a few MB); their ids are the lowest.
HEAD = 50_000
HEAD_CHARS = 100
# Most bytes of text that one call of a batch tokenizer gets, unless one text has more.
HOOK_BYTES = 1 << 20


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, occurrences)`` over the whole corpus."""
    return (df.select(F.explode(split_words(text)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("occurrences")))


def build_vocab(df: DataFrame, max_size: int | None = None, text: str = "text",
                first_id: int = FIRST_WORD_ID) -> DataFrame:
    """The ``max_size`` most frequent words (``None``: all), ``id = first_id +
    rank`` by ``(count desc, word)``: exact distributed ranks over the distinct-word
    table (range partitioning, see ``dense_index``), whatever the size."""
    if max_size is not None and max_size <= 0:
        raise ValueError("max_size must be positive")
    ranked = dense_index(word_counts(df, text), [F.desc("occurrences"), F.asc("word")], out="__rank", total=None)
    if max_size is not None:
        ranked = ranked.where(F.col("__rank") < max_size)
    return ranked.select("word", "occurrences", (F.col("__rank") + F.lit(first_id)).cast("bigint").alias("id"))


def tokenize_with_vocab(df: DataFrame, vocab: DataFrame, keys: Sequence[str] = ("doc_id",), text: str = "text",
                        out: str = "input_ids", unk_id: int = UNK_ID, head: int = HEAD) -> DataFrame:
    """T1(b): the ``keys`` columns of every row and ``out``, its ids from a fixed vocabulary of
    any size. Rows out = rows in; a null or empty text gives an empty array.

    No text and no single word occurrence is shuffled. The ``head`` most frequent words
    (a bound on what is broadcast) have their ids looked up where the text is read. The
    other distinct words of a text go to the vocabulary once each (equal texts of a task
    ask once) and come back as one row of their ids, to take their places in the text's
    own ids, which move once, as 4 bytes a word. So ids are 0 .. 2^31-1, of texts of under
    2^31 words."""
    ranked = vocab.where("word IS NOT NULL AND id IS NOT NULL").select("word", F.col("id").cast("bigint").alias("id"))
    # very long words are looked up as rare ones: the broadcast is bounded in bytes too
    first = ranked.where(F.length("word") <= HEAD_CHARS).orderBy("id").limit(head).collect() if head else []
    known = df.sparkSession.sparkContext.broadcast({r.word: r.id for r in first})
    texts = df.select(F.col(text).alias("text"))
    asked = map_batches(texts, ["text"], "t binary, i bigint, word string", _rare_words(known))
    # a word's number in its text in the upper half, its id in the lower
    place = F.shiftleft("i", 32) + F.coalesce("id", F.lit(unk_id).cast("bigint"))
    found = asked.join(ranked, "word", "left").select("t", place.alias("place"))
    rare = found.groupBy("t").agg(F.collect_list("place").alias("places"))
    rare = rare.select("t", F.transform(F.sort_array(F.array_distinct("places")),
                                        lambda x: x.bitwiseAND(F.lit(2**31 - 1).cast("bigint"))).alias("rare"))
    names = [f"k{i}" for i in range(len(keys))]
    read = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(text).alias("text"))
    schema = T.StructType([read.schema[n] for n in names] + [T.StructField("t", T.BinaryType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    own = read.mapInArrow(frugal(_own_ids(known)), schema)
    whole = F.transform("ids", lambda x: F.when(x < 0, F.element_at("rare", -x)).otherwise(x.cast("bigint")))
    return own.join(rare, "t", "left").select(*[F.col(n).alias(k) for k, n in zip(keys, names)], whole.alias(out))


def _looked_up(texts: list[str | None], known: dict[str, int]) -> Iterator[tuple[bytes, list[int], dict[str, int]]]:
    """Each text's digest, its ids, and its words that aren't ``known``; their ids are
    numbered -1, -2 .. as they come."""
    words = re.compile(WORD_PATTERN).findall
    for text in texts:
        ids, rare = [], {}
        for w in words(text or ""):
            x = known.get(w)
            ids.append(rare.setdefault(w, -len(rare) - 1) if x is None else x)
        yield hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest(), ids, rare


def _rare_words(known):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for whole in batches:
            for batch in text_chunks(whole, "text", HOOK_BYTES):
                t, i, word = [], [], []
                for digest, _, rare in _looked_up(batch.column("text").to_pylist(), known.value):
                    if digest not in seen:
                        seen.add(digest)
                        t += [digest] * len(rare)
                        i += range(1, len(rare) + 1)
                        word += rare
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(i, pa.int64()), pa.array(word, pa.string())], ["t", "i", "word"])

    return rows


def _own_ids(known):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, "text", HOOK_BYTES):
                found = list(_looked_up(batch.column("text").to_pylist(), known.value))
                ends = np.cumsum([0] + [len(ids) for _, ids, _ in found])
                ids = pa.array(np.concatenate([np.array(ids, np.int32) for _, ids, _ in found]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.drop_columns("text").columns, pa.array([t for t, _, _ in found], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], [*batch.drop_columns("text").schema.names, "t", "ids"])

    return rows


def tokenize_with(df: DataFrame, fn: Callable[[list[str]], Iterable[Iterable[int]]], text: str = "text",
                  out: str = "input_ids") -> DataFrame:
    """T1(c): any batch tokenizer ``list[str] -> list[list[int]]`` (e.g. a loaded
    subword tokenizer's batch encode), run on Arrow batches in the Python workers. A call
    gets texts of ``HOOK_BYTES`` together, or one text, so a worker holds the ids of no more,
    however many rows an Arrow batch has."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for batch in text_chunks(pa.RecordBatch.from_arrays([whole], ["text"]), "text", HOOK_BYTES):
                texts = [t if t is not None else "" for t in batch.column("text").to_pylist()]
                ids = [np.fromiter(map(int, x), np.int64) for x in fn(texts)]
                if len(ids) != len(texts):
                    raise ValueError(f"the tokenizer gave {len(ids)} results for {len(texts)} texts")
                ends = np.cumsum([0] + [len(x) for x in ids])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))

    return df.withColumn(out, encode(F.col(text)))


_LOADED: dict = {}


def tokenizer_file_hook(spark, path: str, add_special_tokens: bool = False):
    """A batch encoder for ``tokenize_with`` from a ``tokenizer.json`` file (the
    ``tokenizers`` library): the file is shipped with ``SparkContext.addFile`` and
    loaded once per Python worker; no truncation, no padding, like the reference's
    tokenizer call."""
    import os

    from pyspark import SparkFiles

    try:
        import tokenizers  # noqa: F401
    except ImportError as e:  # pragma: no cover - optional dependency
        raise ImportError("tokenizer_file_hook needs the 'tokenizers' package") from e
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def encode(texts: list[str]) -> list[list[int]]:
        from tokenizers import Tokenizer
        tok = _LOADED.get(name)
        if tok is None:
            tok = _LOADED[name] = Tokenizer.from_file(SparkFiles.get(name))
        return [e.ids for e in tok.encode_batch(texts, add_special_tokens=add_special_tokens)]

    return encode


def hashed_word_tokenizer(id_space: int = 50000, offset: int = 16) -> Callable[[list[str]], list[list[int]]]:
    """A plain-Python batch function with the native tokenizer's rule (md5 of each
    word), usable with ``tokenize_with``; it lets the hook path be checked against
    the native path."""
    pattern = re.compile(WORD_PATTERN)

    def encode(texts: list[str]) -> list[list[int]]:
        return [[int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16) % id_space + offset
                 for w in pattern.findall(t)] for t in texts]

    return encode
