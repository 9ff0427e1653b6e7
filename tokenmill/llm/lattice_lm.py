"""Language-model score by subword lattice: the marginal probability of a text over all
its segmentations.

The pieces and their scores come from an existing vocabulary file (a ``sentencepiece``
model; its pieces are ordered by score). A text is a series of words and then an end;
a word, with the mark of its beginning, is any series of pieces that spell it. Every
series of pieces counts: the forward recursion ``a[i] = log sum_p exp(a[i - |p|] + log
P(p))`` gives a word's marginal, and a text's is the sum over its words and the end.
Characters outside the vocabulary are spelled with its byte pieces, so every text has a
probability above 0.

The scores' ranks give the first piece probabilities (a rank's share falls as 1 / rank).
Expectation-maximisation over the training rows then weights them: each round runs
forward and backward over the training corpus's distinct words, weighted by their
counts, and expected piece counts (one row per piece) become the new probabilities.

Counts of all training words are exact and distributed; the same table gives the plain
add-one word model. Words travel as 64-bit hashes with a text's counts of them; words
frequent enough to be at most 1 / ``COMMON`` many are looked up from a broadcast
table of that bound, all others are joined. (Two of 10^7 words share a hash with a
chance of 3e-6.) Words are ASCII-lower-cased runs of characters other than space and
\\t to \\r. Null counts as empty text: only the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.frames import map_batches, stored, text_chunks
from tokenmill.llm.subwords import WordBatch
from tokenmill.llm.tokens import tokenizer_path

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
COMMON = 1e-6
# Pseudo-count of every piece, so that none has probability 0.
PRIOR = 0.1
MARK = "▁"
# Longest word whose letters are walked through for many words at once.
TOGETHER = 48
CELLS = 400_000
END = "</s>"
LN10 = float(np.log(10.0))
# Distinct words a task holds before it passes their counts on.
HELD = 400_000


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces by falling score, then its byte pieces (which have none)
    and the end."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(not sp.is_byte(i), sp.get_score(i), -i, sp.id_to_piece(i)) for i in range(sp.get_piece_size())
            if not sp.is_control(i) and not sp.is_unknown(i)]
    return [row[-1] for row in sorted(rows, reverse=True)] + [END]


class Lattice:
    """Piece log-probabilities (natural) with the lookups that the recursion needs."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        self.pieces, self.logp = pieces, logp
        self.end = len(pieces) - 1
        self.byte = np.full(256, -1)
        spelled = {}
        for i, p in enumerate(pieces[:-1]):
            if len(p) == 6 and p.startswith("<0x") and p.endswith(">"):
                self.byte[int(p[3:5], 16)] = i
            elif p:
                spelled[p] = i
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no byte pieces")
        self.spelled = spelled
        self.longest = max(map(len, spelled))
        # a hash table of all beginnings of pieces: the piece that is one, or -1 if it
        # only begins some; -2 marks a free slot
        known: dict[int, int] = {}
        for p, i in spelled.items():
            h = 0
            for k, c in enumerate(p):
                h = self._extend_one(h, ord(c))
                known[h] = i if k == len(p) - 1 else known.get(h, -1)
        size = 1 << (4 * len(known)).bit_length()
        self.mask = size - 1
        self.slot_hash, self.slot_piece = np.zeros(size, np.uint64), np.full(size, -2, np.int64)
        for h, i in known.items():
            slot = h & self.mask
            while self.slot_piece[slot] != -2:
                slot = (slot + 1) & self.mask
            self.slot_hash[slot], self.slot_piece[slot] = h, i

    @staticmethod
    def _extend_one(h: int, letter: int) -> int:
        h = (h + letter + 1) * 0x9E3779B97F4A7C15 % 2**64
        return h ^ (h >> 29)

    @staticmethod
    def extend(h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (h + letter + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if it only begins pieces, -2 for neither."""
        slot = (h & np.uint64(self.mask)).astype(np.int64)
        piece = self.slot_piece[slot]
        wrong = np.flatnonzero((piece != -2) & (self.slot_hash[slot] != h))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            piece[wrong] = self.slot_piece[slot[wrong]]
            wrong = wrong[(piece[wrong] != -2) & (self.slot_hash[slot[wrong]] != h[wrong])]
        return piece

    def _spelling(self, letter: int) -> list[int]:
        return self.byte[list(chr(letter).encode("utf-8", "surrogatepass"))].tolist()

    def _edges(self, letters: np.ndarray):
        """``(begin, end, word, piece)`` of all pieces in words of one length (a row of
        letters each), and the letters that only byte pieces spell, as ``(place, word)``."""
        n, size = letters.shape
        spelled = np.ones((n, size), bool)
        edges = []
        for begin in range(size):
            rows, h = np.arange(n), np.zeros(n, np.uint64)
            for end in range(begin + 1, size + 1):
                h = self.extend(h, letters[rows, end - 1].astype(np.uint64))
                piece = self.find(h)
                hit = piece >= 0
                if hit.any():
                    edges.append((begin, end, rows[hit], piece[hit]))
                    if end == begin + 1:
                        spelled[rows[hit], begin] = False
                go = piece > -2  # beginnings of longer pieces
                rows, h = rows[go], h[go]
                if not len(rows):
                    break
        return edges, spelled

    def marginal(self, words: list[str], weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural-log marginal of each word, and with ``weight`` the expected number
        of uses of every piece."""
        out = np.zeros(len(words))
        expected = np.zeros(len(self.pieces)) if weight is not None else None
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            stop = int(np.searchsorted(sizes[order], size, side="right"))
            stop = min(stop, at + max(1, CELLS // size))
            ids = order[at:stop]
            at = stop
            some = [MARK + words[i] for i in ids.tolist()]
            w = weight[ids] if weight is not None else None
            if size > TOGETHER:
                for i, word in zip(ids.tolist(), some):
                    out[i] = self._alone(word, expected, weight[i] if weight is not None else 0.0)
            else:
                letters = np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size)
                out[ids] = self._together(letters, w, expected)
        return out, expected

    def _together(self, letters, weight, expected):
        n, size = letters.shape
        edges, spelled = self._edges(letters)
        odd = {}
        for place in range(size):
            rows = np.flatnonzero(spelled[:, place])
            if len(rows):
                codes = letters[rows, place]
                bytes_of = {int(c): self._spelling(int(c)) for c in np.unique(codes)}
                cost = np.array([self.logp[bytes_of[int(c)]].sum() for c in codes])
                odd[place] = (rows, codes, cost, bytes_of)
        by_begin: dict[int, list] = {}
        for e in edges:
            by_begin.setdefault(e[0], []).append(e)
        ahead = np.full((size + 1, n), -np.inf)
        ahead[0] = 0
        for begin in range(size):
            for _, end, rows, piece in by_begin.get(begin, []):
                ahead[end, rows] = np.logaddexp(ahead[end, rows], ahead[begin, rows] + self.logp[piece])
            if begin in odd:
                rows, _, cost, _ = odd[begin]
                ahead[begin + 1, rows] = np.logaddexp(ahead[begin + 1, rows], ahead[begin, rows] + cost)
        total = ahead[size]
        if expected is not None:
            behind = np.full((size + 1, n), -np.inf)
            behind[size] = 0
            for begin in range(size - 1, -1, -1):
                for _, end, rows, piece in by_begin.get(begin, []):
                    behind[begin, rows] = np.logaddexp(behind[begin, rows], behind[end, rows] + self.logp[piece])
                    use = np.exp(ahead[begin, rows] + self.logp[piece] + behind[end, rows] - total[rows])
                    expected += np.bincount(piece, use * weight[rows], len(expected))
                if begin in odd:
                    rows, codes, cost, bytes_of = odd[begin]
                    behind[begin, rows] = np.logaddexp(behind[begin, rows], behind[begin + 1, rows] + cost)
                    use = np.exp(ahead[begin, rows] + cost + behind[begin + 1, rows] - total[rows]) * weight[rows]
                    for c in np.unique(codes):
                        np.add.at(expected, bytes_of[int(c)], use[codes == c].sum())
        return total

    def _alone(self, word: str, expected, weight: float) -> float:
        """The same recursion for one long word."""
        size = len(word)
        edges: list[list[tuple[int, float, list[int]]]] = []
        for begin in range(size):
            own = []
            for end in range(begin + 1, min(size, begin + self.longest) + 1):
                piece = self.spelled.get(word[begin:end])
                if piece is not None:
                    own.append((end, float(self.logp[piece]), [piece]))
            if not own or own[0][0] != begin + 1:
                spelling = self._spelling(ord(word[begin]))
                own.append((begin + 1, float(self.logp[spelling].sum()), spelling))
            edges.append(own)
        ahead = np.full(size + 1, -np.inf)
        ahead[0] = 0
        for begin, own in enumerate(edges):
            for end, cost, _ in own:
                ahead[end] = np.logaddexp(ahead[end], ahead[begin] + cost)
        if expected is not None:
            behind = np.full(size + 1, -np.inf)
            behind[size] = 0
            for begin in range(size - 1, -1, -1):
                for end, cost, pieces in edges[begin]:
                    behind[begin] = np.logaddexp(behind[begin], behind[end] + cost)
                    use = weight * float(np.exp(ahead[begin] + cost + behind[end] - ahead[size]))
                    np.add.at(expected, pieces, use)
        return float(ahead[size])


def initial(pieces: list[str]) -> np.ndarray:
    """From the vocabulary's order; the end gets the share of one piece in a hundred."""
    share = 1.0 / (np.arange(len(pieces)) + 10.0)
    share[-1] = share[:-1].sum() / 100
    return np.log(share / share.sum())


def _words(batch: pa.Array) -> WordBatch:
    return WordBatch(pc.ascii_lower(batch))


def _hashes(words) -> np.ndarray:
    return np.fromiter([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64, len(words)).view(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def flush():
        words = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(words)), pa.array(words, pa.binary()).view(pa.string()),
                                          pa.array(held.values(), pa.int64())], ["h", "word", "c"])
        held.clear()

    for whole in batches:
        for batch in text_chunks(whole, "text"):
            words = _words(batch.column("text"))
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(words.word, train[words.doc], len(words.words)).astype(np.int64).tolist()
            get = held.get
            for w, c in zip(words.words.tolist(), counts):
                held[w] = get(w, 0) + c
            if len(held) > HELD:
                yield from flush()
    if held:
        yield from flush()


def word_counts(rows: DataFrame) -> DataFrame:
    """``h, word, c`` of rows ``text, train``: every distinct word with its hash and
    its count in the training texts (0 for words of other texts only)."""
    counts = map_batches(rows, ["text", "train"], "h bigint, word string, c bigint", _count_words)
    return counts.groupBy("h").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def fit(counts: DataFrame, texts: int, rounds: int = ROUNDS, vocabulary: str | None = None) -> Lattice:
    """Piece probabilities by EM over distinct words with counts, and ``texts`` ends."""
    pieces = load_pieces(vocabulary or tokenizer_path(VOCABULARY))
    logp = initial(pieces)
    spark = counts.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, logp))  # the vocabulary's size

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            total = np.zeros(len(lattice.pieces))
            for batch in batches:
                for part in text_chunks(batch, "word", 1 << 20):
                    words = part.column("word").to_numpy(zero_copy_only=False).tolist()
                    total += lattice.marginal(words, part.column("c").to_numpy().astype(float))[1]
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "uses"])

        table = (map_batches(counts.where("c > 0"), ["word", "c"], "piece bigint, uses double", expect)
                 .groupBy("piece").agg(F.sum("uses").alias("uses")).orderBy("piece").toArrow())  # one row per piece
        uses = np.full(len(pieces), PRIOR)
        uses[table.column("piece").to_numpy()] += table.column("uses").to_numpy()
        uses[-1] += texts
        logp = np.log(uses / uses.sum())
        shared.unpersist()
    return Lattice(pieces, logp)


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", vocabulary: str | None = None,
          rounds: int = ROUNDS, common: float = COMMON) -> DataFrame:
    """For every row of ``docs``: ``key``, ``n_tokens`` (words and the end), ``n_known``
    (seen in the rows where ``train`` holds), ``train_tokens``, ``base_score`` (add-one
    word model) and ``score`` (the lattice), both as log10 probabilities."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.xxhash64(F.col(text)).alias("t"))
    texts = rows.where("train").select("key").count()
    seen = stored(word_counts(rows), "word-counts")
    n_words, n_distinct = (int(x or 0) for x in seen.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first())
    n, v = n_words + texts, n_distinct + (texts > 0)
    lattice = fit(seen, texts, rounds, vocabulary)
    model = spark.sparkContext.broadcast((lattice.pieces, lattice.logp))  # the vocabulary's size
    space = float(n + (v + 1))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lattice(*model.value)
        for batch in batches:
            for part in text_chunks(batch, "word", 1 << 20):
                words = part.column("word").to_numpy(zero_copy_only=False).tolist()
                base = np.log10((part.column("c").to_numpy() + 1) / space)
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("c"), pa.array(base),
                                                  pa.array(own.marginal(words)[0] / LN10)], ["h", "c", "b", "p"])

    weighed = stored(map_batches(seen, ["h", "word", "c"], "h bigint, c bigint, b double, p double", weigh), "word-scores")
    bound = max(2.0, common * n)
    frequent = weighed.where(F.col("c") >= bound).orderBy("h").toArrow()  # at most 1 / common rows
    table = spark.sparkContext.broadcast(tuple(frequent.column(c).to_numpy() for c in ("h", "b", "p")))
    end = (float(np.log10((texts + 1) / space)), float(lattice.logp[lattice.end]) / LN10)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text a head row with what the frequent words and the end add up to, and
        a row with hash and count for every other word of it."""
        hashes, base, logs = table.value
        for whole in batches:
            for batch in text_chunks(whole, "text", 4 << 20):
                words = _words(batch.column("text"))
                docs_, h = len(words.ends), _hashes(words.words)
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                hit = (hashes[at] == h) if len(hashes) else np.zeros(len(h), bool)
                often = hit[words.word]
                own, doc = at[words.word[often]], words.doc[often]
                pair, tf = np.unique(words.doc[~often] * len(h) + words.word[~often], return_counts=True)
                d, w = pair // max(1, len(h)), pair % max(1, len(h))
                row = np.concatenate([np.arange(docs_), d])
                head = np.arange(len(row)) < docs_
                none = pa.nulls(len(d), pa.int64())

                def with_head(values, kind):
                    return pa.concat_arrays([pa.array(values, kind), none.cast(kind)])

                t = batch.column("t").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(row)), batch.column("t").take(pa.array(row)), pa.array(head),
                     pa.array(np.concatenate([t, h[w]])), pa.array(np.concatenate([np.ones(docs_, np.int64), tf])),
                     with_head(np.diff(words.ends, prepend=0) + 1, pa.int64()),
                     with_head(np.bincount(doc, minlength=docs_) + (texts > 0), pa.int64()),
                     with_head(np.bincount(doc, base[own], docs_) + end[0], pa.float64()),
                     with_head(np.bincount(doc, logs[own], docs_) + end[1], pa.float64())],
                    ["key", "t", "head", "h", "tf", "n_tokens", "n_known", "base", "lattice"])

    kind = docs.schema[key].dataType.simpleString()
    looked = map_batches(rows, ["key", "t", "text"], f"key {kind}, t bigint, head boolean, h bigint, tf bigint, "
                         "n_tokens bigint, n_known bigint, base double, lattice double", look_up)
    joined = looked.join(weighed, "h", "left")
    word = ~F.col("head")
    added = joined.groupBy("key", "t").agg(
        F.count_if("head").alias("rows"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(word & (F.col("c") > 0), F.col("tf")).otherwise(F.coalesce("n_known", F.lit(0)))).alias("n_known"),
        F.sum(F.when(word, F.col("tf") * F.col("b")).otherwise(F.col("base"))).alias("base"),
        F.sum(F.when(word, F.col("tf") * F.col("p")).otherwise(F.col("lattice"))).alias("lattice"))
    # rows equal in key and text were added up together
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))
    return added.select(F.col("key").alias(key), "n_tokens", (F.col("n_known") / F.col("rows")).cast("bigint").alias("n_known"),
                        F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base_score"),
                        (F.col("lattice") / F.col("rows")).alias("score"), copies.alias("__copy")).drop("__copy")
