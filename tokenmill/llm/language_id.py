"""Language identification by a language-bitmask n-gram filter.

A bit-sliced Bloom filter: each of its positions holds one bit per language (in as many
64-bit words as the languages need), so the AND of an n-gram's ``HASHES`` positions
names all languages that contain it at once. A
text's n-grams are looked up, set bits are counted per language, and the counts are
corrected for false positives: with a share f of a language's bits set, a stranger
passes with chance p = f^HASHES, so ``(hits - n p) / (1 - p)`` estimates the true hits.
The language with the most wins; the score is its part of all languages' hits.

A language contains an n-gram if the n-gram makes up at least ``MIN_SHARE`` of the
language's training n-grams. So a stray passage in another tongue does not enter, and
the filter's size is bounded by the parameters and the languages, not by the corpus:
at most 1 / MIN_SHARE n-grams a language. Counts cover all training rows; they are
summed per task before the shuffle.

N-grams are of lower-cased letters, with one space for each run of other characters.
Texts that are null or have no letter are ``und`` with score 0; a text none of whose
n-grams is known gets the language with most training n-grams and score 0. Ties go to
the language first in order. Without training rows every text is ``und``. Very long texts
are judged whole, one at a time; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.frames import map_batches, stored, text_chunks

SIZES = (2, 3, 4)
HASHES = 4
#: Filter positions for each n-gram kept (times the languages that share it, at most).
POSITIONS = 12
MIN_SHARE = 1e-5
UNKNOWN = "und"
_SPACE = 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F),
        np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
# Bytes of text whose n-grams a task holds at a time.
CHUNK = 2 << 20
# N-grams of one size that a table over all combinations of a text's letters may have.
TABLE = 1 << 21
# Distinct n-grams a task holds before it passes their counts on.
HELD = 1_000_000
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """A flag for every code point, made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _letters(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts' letters and spaces, where each text begins (every
    one has a space at least), and which texts have a letter."""
    lowered = [t.lower() if t else "" for t in texts]
    code = np.frombuffer("".join([f" {t} \n" for t in lowered]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, lowered), np.int64, len(texts)) + 3
    begins = np.cumsum(sizes) - sizes
    letter = _is_letter()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[begins] = True  # each text begins with its own space
    place = np.cumsum(keep)
    starts = place[begins] - 1
    has = np.add.reduceat(letter, begins, dtype=np.int64) > 0
    return np.where(letter, code, np.uint32(_SPACE))[keep], starts, has


def _hashed(codes: Sequence[np.ndarray]) -> np.ndarray:
    """The hash of each n-gram of the given first, second .. code points."""
    h = np.full(len(codes[0]), len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for mix, code in zip(_MIX, codes):
            h += code
            h *= mix
            h ^= h >> np.uint64(29)
    return _mixed(h)


def _beyond(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Places of code points at which no n-gram of one text begins."""
    ends = np.append(starts[1:], length)
    places = [(ends - j)[ends - j >= starts] for j in range(1, n)]
    return np.concatenate(places)


def _alphabet(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points in use, and the place of each of ``code`` among them."""
    used = np.zeros(int(code.max(initial=0)) + 1, bool)
    used[code] = True
    place = np.cumsum(used, dtype=np.uint32) - np.uint32(1)
    return np.flatnonzero(used), place[code]


def _numbered(digits: np.ndarray, base: int, n: int, kind: type) -> np.ndarray:
    """A number for the n-gram that begins at each place (past the end: digits 0)."""
    digits = np.append(digits, np.zeros(n - 1, digits.dtype)).astype(kind)
    last = len(digits) - n + 1
    out = digits[:last].copy()
    for i in range(1, n):
        out *= kind(base)
        out += digits[i:i + last]
    return out


def _named(numbers: np.ndarray, alphabet: np.ndarray, n: int) -> np.ndarray:
    """The hashes of n-grams by their numbers."""
    base, rest = len(alphabet), numbers.astype(np.int64)
    return _hashed([alphabet[rest // base**i % base].astype(np.uint64) for i in range(n - 1, -1, -1)])


def ngrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text, hash)`` of every n-gram of every text, and which texts have a letter."""
    code, starts, has = _letters(texts) if len(texts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool))
    doc = np.repeat(np.arange(len(texts)), np.diff(starts, append=len(code)))
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for n in SIZES:
        inside = np.ones(len(code), bool)
        inside[_beyond(starts, len(code), n)] = False
        at = np.flatnonzero(inside)
        hashes.append(_hashed([code[at + i] for i in range(n)]))
        owners.append(doc[at])
    return np.concatenate(owners), np.concatenate(hashes), has


def counted(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all n-grams of the texts and how often each occurs; n-grams of one
    size are told apart by numbers, so only distinct ones are hashed."""
    code, starts, _ = _letters(texts)
    alphabet, digits = _alphabet(code)
    base, hashes, counts = len(alphabet), [], []
    for n in SIZES:
        inside = np.ones(len(code), bool)
        inside[_beyond(starts, len(code), n)] = False
        if base**n <= TABLE:
            times = np.bincount(_numbered(digits, base, n, np.uint32)[inside], minlength=base**n)
            number = np.flatnonzero(times)
            hashes.append(_named(number, alphabet, n))
            counts.append(times[number])
        elif base**n < 1 << 62:
            kind = np.uint32 if base**n < 1 << 32 else np.uint64
            number, times = np.unique(_numbered(digits, base, n, kind)[inside], return_counts=True)
            hashes.append(_named(number, alphabet, n))
            counts.append(times)
        else:
            at = np.flatnonzero(inside)
            gram, times = np.unique(_hashed([code[at + i] for i in range(n)]), return_counts=True)
            hashes.append(gram)
            counts.append(times)
    return np.concatenate(hashes), np.concatenate(counts)


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray    # per position, a bit per language: a column per 64 of them
    chance: np.ndarray   # per language, that a stranger passes
    common: int          # the language with most training n-grams

    @classmethod
    def build(cls, languages: list[str], grams: np.ndarray, owned: np.ndarray, common: int) -> "LanguageFilter":
        """``owned``: the masks (a column per 64 languages) of those that contain each of ``grams``."""
        size = 1 << max(10, int(np.ceil(np.log2(max(1, len(grams)) * POSITIONS))))
        kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * k(0).nbytes), np.uint64)
        owned = owned.astype(kind)  # a small filter is looked up faster
        masks = np.zeros((size, owned.shape[1]), kind)
        for at in cls._positions(grams, size):
            np.bitwise_or.at(masks, at, owned)
        filled = [float(cls._bit(masks, i).mean()) for i in range(len(languages))]
        return cls(languages, masks, np.array(filled) ** HASHES, common)

    @staticmethod
    def _bit(masks: np.ndarray, language: int) -> np.ndarray:
        kind = masks.dtype.type
        return masks[:, language // 64] >> kind(language % 64) & kind(1)

    @staticmethod
    def _positions(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """Double hashing: the positions of ``grams``, hash by hash."""
        step, place = (grams >> np.uint64(32)) | np.uint64(1), grams.copy()
        for _ in range(HASHES):
            yield (place & np.uint64(size - 1)).view(np.int64)
            with np.errstate(over="ignore"):
                place += step

    def contains(self, grams: np.ndarray) -> np.ndarray:
        found = None
        for at in self._positions(grams, len(self.masks)):
            found = self.masks[at] if found is None else np.bitwise_and(found, self.masks[at], out=found)
        return found

    def _found(self, code: np.ndarray, alphabet: np.ndarray, digits: np.ndarray, n: int) -> np.ndarray:
        """The masks of the n-grams that begin at each place of ``code``. Where a table of
        all combinations of the letters is small, each n-gram is looked up once."""
        base = len(alphabet)
        if base**n > TABLE:
            padded = np.append(code, np.zeros(n - 1, code.dtype))
            return self.contains(_hashed([padded[i:i + len(code)] for i in range(n)]))
        numbers = _numbered(digits, base, n, np.uint32)
        met = np.zeros(base**n, bool)
        met[numbers] = True
        met = np.flatnonzero(met)
        table = np.zeros((base**n, self.masks.shape[1]), self.masks.dtype)
        table[met] = self.contains(_named(met, alphabet, n))
        return table[numbers]

    def judge(self, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.languages)
        if not k or not n:
            return [UNKNOWN] * n, np.zeros(n)
        code, starts, has = _letters(texts)
        alphabet, digits = _alphabet(code)
        size = np.diff(starts, append=len(code))
        total, hits = np.zeros(n, np.int64), np.zeros((n, k), np.int64)
        for length in SIZES:
            found = self._found(code, alphabet, digits, length)
            found[_beyond(starts, len(code), length)] = 0
            total += np.maximum(size - length + 1, 0)
            for i in range(k):
                hits[:, i] += np.add.reduceat(self._bit(found, i), starts, dtype=np.int64)
        true = np.maximum((hits - total[:, None] * self.chance) / (1 - self.chance), 0)
        best = true.argmax(1)
        every = true.sum(1)
        none = every <= 0
        score = np.where(none, 0, true[np.arange(n), best] / np.where(none, 1, every))
        best[none] = self.common
        names = [self.languages[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
        return names, np.clip(np.where(has, score, 0), 0, 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def total(lang):
        grams, n = (np.concatenate(x) for x in zip(*held[lang]))
        grams, at = np.unique(grams, return_inverse=True)
        held[lang] = [(grams, np.bincount(at, n).astype(np.int64))]

    def flush():
        for lang in held:
            total(lang)
            grams, n = held[lang][0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)],
                                             ["lang", "gram", "n"])
        held.clear()

    for whole in batches:
        for batch in text_chunks(whole, "text", CHUNK):
            lang = batch.column("lang").to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_numpy(zero_copy_only=False)
            for name in sorted(set(lang)):
                held.setdefault(name, []).append(counted(texts[lang == name].tolist()))
                if len(held[name]) > 8:
                    total(name)
        if sum(len(g) for parts in held.values() for g, _ in parts) > HELD:
            yield from flush()
    yield from flush()


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> LanguageFilter:
    """A filter from texts with a language (rows lacking either are left out)."""
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = stored(map_batches(rows, ["lang", "text"], "lang string, gram bigint, n bigint", _counts)
                    .groupBy("lang", "gram").agg(F.sum("n").alias("n")), "gram-counts")  # read three times
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))  # one row per language
    kept = counts.join(F.broadcast(totals), "lang").where(F.col("n") >= F.lit(min_share) * F.col("total"))
    table = kept.select("lang", "gram").toArrow()  # at most 1 / min_share rows a language
    sums = {r["lang"]: r["total"] for r in totals.collect()}  # also of one whose n-grams are all too rare
    languages = sorted(sums)
    place = {name: i for i, name in enumerate(languages)}
    grams, at = np.unique(table.column("gram").to_numpy().view(np.uint64), return_inverse=True)
    owner = np.fromiter((place[x] for x in table.column("lang").to_pylist()), np.int64, table.num_rows)
    owned = np.zeros((len(grams), -(-max(1, len(languages)) // 64)), np.uint64)
    np.bitwise_or.at(owned, (at, owner // 64), np.uint64(1) << (owner % 64).astype(np.uint64))
    common = max(range(len(languages)), key=lambda i: (sums[languages[i]], -i), default=0)
    return LanguageFilter.build(languages, grams, owned, common)


def identify(docs: DataFrame, model: LanguageFilter, keep: Sequence[str], text: str = "text",
             out: str = "lang_pred", out_score: str = "lang_score") -> DataFrame:
    """The ``keep`` columns, the language ``out`` and ``out_score`` (0 to 1), which
    replace columns of these names."""
    keep = [c for c in keep if c not in (out, out_score)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, T.StringType()),
                                                            T.StructField(out_score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by min_share and the languages

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, text, CHUNK):
                names, scores = shared.value.judge(batch.column(text).to_numpy(zero_copy_only=False).tolist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()),
                                                  pa.array(scores, pa.float64())], [*keep, out, out_score])

    return map_batches(docs, list(dict.fromkeys([*keep, text])), schema, add)
