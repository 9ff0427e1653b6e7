"""Hashed features of a batch of texts: words, character n-grams of words, and how
words repeat, vectorised over the batch's distinct words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Character n-grams of "<word>".
SIZES = (3, 4, 5)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
        np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))
# Features of their own, after the hashed ones: a three-word window that the text had
# before, one that is new to it, and a word that repeats the one before it.
EXTRA = 3
# Letters of distinct words whose n-grams are held at a time (about 150 bytes each).
LETTERS = 1 << 18


class WordBatch:
    """The words of some texts: ``words`` (distinct, as bytes), ``word`` (position in
    ``words`` of every word of every text, in order) and ``ends`` (of each text)."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        self.words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        self.word = coded.indices.to_numpy().astype(np.int64)
        self.ends = offsets[1:] - offsets[0]
        real = np.fromiter(map(len, self.words), np.int64, len(self.words)) > 0
        if not real.all():  # white space at an end leaves an empty word
            keep = real[self.word]
            self.ends = np.concatenate([[0], np.cumsum(keep)])[self.ends]
            number = np.cumsum(real) - 1
            self.word, self.words = number[self.word[keep]], self.words[real]
        self.doc = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))

    def features(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """``(word, bucket)`` pairs of all distinct words."""
        return _features(self.words, buckets) if len(self.words) else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def feature_blocks(self, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first, end, word, bucket)`` for blocks of the distinct words, ``first`` to ``end``,
        of at most ``LETTERS`` letters or one word: the pairs of each word (counted from
        ``first``) and of its n-grams."""
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 2)
        first = 0
        while first < len(ends):
            before = int(ends[first - 1]) if first else 0
            end = max(int(np.searchsorted(ends, before + LETTERS, side="right")), first + 1)
            yield first, end, *_features(self.words[first:end], buckets)
            first = end

    def repeats(self) -> np.ndarray:
        """Per text (row), the counts of the ``EXTRA`` features."""
        n = len(self.ends)
        out = np.zeros((n, EXTRA), np.int64)
        if len(self.word) >= 2:
            echo = (self.word[1:] == self.word[:-1]) & (self.doc[1:] == self.doc[:-1])
            out[:, 2] = np.bincount(self.doc[1:][echo], minlength=n)
        if len(self.word) >= 3:
            inside = self.doc[2:] == self.doc[:-2]
            with np.errstate(over="ignore"):
                w, d = self.word.astype(np.uint64), self.doc.astype(np.uint64)
                h = _mixed(_mixed(_mixed(w[:-2] * _MIX[0] + d[:-2]) + w[1:-1]) + w[2:])[inside]
            doc = self.doc[2:][inside]
            out[:, 1] = np.bincount(doc[np.unique(h, return_index=True)[1]], minlength=n)
            out[:, 0] = np.bincount(doc, minlength=n) - out[:, 1]
        return out


def _features(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(word, bucket)`` pairs of distinct ``words``: each word, and its n-grams."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    letters = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    room = np.repeat(begins + sizes, sizes) - np.arange(len(letters))  # letters left in the word
    whole = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = [(np.arange(len(sizes)), _mixed(whole + np.uint64(1 << 40)) % np.uint64(buckets))]
    with np.errstate(over="ignore"):
        for n in SIZES:
            at = np.flatnonzero(room >= n)
            h = np.full(len(at), n, np.uint64)
            for i in range(n):
                h = (h + letters[at + i]) * _MIX[i]
                h ^= h >> np.uint64(31)
            pairs.append((owner[at], _mixed(h) % np.uint64(buckets)))
    return np.concatenate([p for p, _ in pairs]), np.concatenate([b for _, b in pairs]).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
