"""Encoding whole texts with a tokenizer file, one Arrow batch at a time.

A public tokenizer splits a text into pieces and encodes each piece alone, and in
natural text few of the pieces are new. ``TextEncoder`` therefore cuts texts where
the tokenizer itself is certain to cut (at white space), encodes each distinct unit
once per worker with the ``tokenizers`` library, and puts a text's ids together from
those of its units. Texts for which that is not certain, and those that hold the string
of an added token (such as ``<|endoftext|>``), are encoded whole, so the ids always equal
the library's plain ``encode(text, add_special_tokens=False)``. With ``special_as_text``
the strings of special tokens are ordinary text. Null counts as empty text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from tokenmill.llm.frames import text_chunks

# White space of every kind the tokenizers know (and a few more); RE2 syntax.
_WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_UNSAFE = f"^{_WS}|{_WS}{_WS}|{_WS}$"
# How a tokenizer file treats white space: "kept" (byte-level pieces that begin with
# the space) or "dropped". Files not named here are encoded text by text.
SPACES = {"byte_bpe_50k.json": "kept", "word_bpe_49k.json": "dropped"}
# The pieces that a "dropped" tokenizer file makes of a word (fixed value: the file's
# own pattern), and the words of which it is used: printable ASCII and Latin letters.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
_PLAIN = regex.compile(r"[\x21-\x7e\u00c0-\u024f]+").fullmatch
# Distinct units that a worker remembers (about 100 MB). The first ones seen stay, as
# frequent units come early; later ones are encoded again in each chunk they occur in.
MAX_UNITS = 500_000
# Units joined into one call of the library.
JOINED = 500
# Bytes of text looked up at a time (a whole batch of rows). The more text, the fewer of its
# units are distinct, and the fewer are looked up; with 8 MB an executor reached 2,999 MB (pipeline).
BYTES_AT_ONCE = 4 << 20
IDS_AT_ONCE = 500_000


def _n_pieces(word: str) -> int:
    """How many pieces a "dropped" tokenizer file makes of a plain word."""
    low = word.lower()
    if low.isalpha():
        return 1
    if low.endswith((",", ".")) and low[:-1].isalpha():
        return 2
    return len(_PIECES(low))


class TextEncoder:
    def __init__(self, path: str, max_units: int = MAX_UNITS, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.path = path
        self.tok = Tokenizer.from_file(path)
        self.special_as_text = special_as_text
        added = [t for t in self.tok.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        if special_as_text:
            self.tok.encode_special_tokens = True
        self.vocab_size = self.tok.get_vocab_size()
        # an added token that is looked for in changed text can't be seen in the text itself
        self.mode = None if any(t.normalized for t in added) else SPACES.get(os.path.basename(path))
        self.added = sorted(t.content for t in added)
        self.max_units = max_units
        if self.mode == "kept":
            vocab = self.tok.get_vocab()
            self.space_first = np.zeros(max(vocab.values()) + 1, bool)
            self.space_first[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
            self.newline = vocab["Ċ"]
        elif self.mode == "dropped":
            vocab = self.tok.get_vocab()
            self.piece_last = np.zeros(max(vocab.values()) + 1, bool)
            self.piece_last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.index: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.used = 0
        self.kept: int | None = None  # ids of the units remembered, once they are as many as may be

    def __reduce__(self):  # a pickled tokenizer would forget how it treats special tokens
        return TextEncoder, (self.path, self.max_units, self.special_as_text)

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _singly(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._plain(units)
        return (np.asarray([i for x in ids for i in x], np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _joined(self, units: list[str], head: str, between: str, cut) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of the units, from calls over ``JOINED`` of them at a time.
        ``cut(ids, group)`` gives the group's ids and sizes, or None where it can't
        tell them apart; then its units are encoded one by one."""
        groups = [units[i:i + JOINED] for i in range(0, len(units), JOINED)]
        out = []
        for group, ids in zip(groups, self._plain([head + between.join(g) for g in groups])):
            out.append(cut(np.asarray(ids, np.uint32), group) or self._singly([head + u for u in group]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _cut_words(self, ids, group):
        first = np.flatnonzero(self.space_first[ids])
        return (ids, np.diff(first, append=len(ids))) if len(first) == len(group) and first[0] == 0 else None

    def _cut_lines(self, ids, group):
        first = np.flatnonzero(ids == self.newline)
        return (ids, np.diff(first, append=len(ids))) if len(first) == len(group) and first[0] == 0 else None

    def _cut_pieces(self, ids, group):
        """Every piece ends in an id that marks a word's end; the pieces of plain
        Latin words are known from the tokenizer's own pattern."""
        pieces = np.fromiter(map(_n_pieces, group), np.int64, len(group))
        last = np.flatnonzero(self.piece_last[ids])
        if len(last) != pieces.sum():
            return None
        return ids, np.diff(np.concatenate([[-1], last])[np.cumsum(pieces)], prepend=-1)

    def _encode_units(self, units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions in ``units``, their ids and their sizes, group by group."""
        if self.mode == "dropped":
            kind = np.fromiter([0 if u.isascii() and u.isprintable() or _PLAIN(u) else 1 for u in units], np.int8, len(units))
            how = [lambda x: self._joined(x, "", " ", self._cut_pieces), self._singly]
        else:
            kind = np.fromiter([2 if u == "\n" else u[0] == "\n" for u in units], np.int8, len(units))
            how = [lambda x: self._joined(x, " ", " ", self._cut_words),
                   lambda x: self._joined(x, "", "", self._cut_lines), self._singly]
        for k, encode in enumerate(how):
            at = np.flatnonzero(kind == k)
            if len(at):
                yield at, *encode([units[i] for i in at.tolist()])

    def _places(self, units: list[str]) -> np.ndarray:
        if self.kept is None and len(self.index) >= self.max_units:
            self.kept = int((self.start + self.size)[:self.max_units].max(initial=0))
        if self.kept is not None:  # units that were not remembered give way
            self.used = self.kept
        at = np.fromiter(map(self.index.get, units, repeat(-1)), np.int64, len(units))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [units[i] for i in new.tolist()]
            first = len(self.index)
            self.index.update(zip(fresh[:max(self.max_units - first, 0)], range(first, first + len(fresh))))
            if first + len(fresh) > len(self.size):  # room for half as many again
                room = np.zeros(first // 2 + len(fresh), np.int64)
                self.size, self.start = np.concatenate([self.size, room]), np.concatenate([self.start, room])
            for where, ids, size in self._encode_units(fresh):
                if self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.zeros(self.used // 2 + len(ids), np.uint32)])
                self.flat[self.used:self.used + len(ids)] = ids
                self.size[first + where] = size
                self.start[first + where] = self.used + np.cumsum(size) - size
                self.used += len(ids)
            at[new] = np.arange(first, first + len(fresh))
        return at

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first row, ids, ends)`` for runs of rows that cover ``texts`` in order;
        the ids of the run's row ``i`` end at ``ends[i]``."""
        texts = pc.fill_null(texts, "")
        if self.mode is None or not len(texts):
            yield from self._whole(texts, np.arange(len(texts)))
            return
        first = 0
        for chunk in text_chunks(pa.record_batch([texts], ["text"]), "text", BYTES_AT_ONCE):
            for row, ids, ends in self._encode_chunk(chunk.column("text")):
                yield first + row, ids, ends
            first += chunk.num_rows

    def _encode_chunk(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if self.mode == "kept":
            safe = pc.invert(pc.match_substring_regex(texts, _UNSAFE)).to_numpy(zero_copy_only=False)
            lined = pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), "")
            split = pc.split_pattern(lined, " ")
        else:
            safe = np.ones(len(texts), bool)
            split = pc.ascii_split_whitespace(texts)
        for content in self.added:
            safe = safe & ~pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        ends = split.offsets.to_numpy()[1:].astype(np.int64)
        ends -= int(split.offsets[0].as_py())
        coded = split.flatten().dictionary_encode()
        del split
        if not safe.any():
            yield from self._whole(texts, np.arange(len(texts)))
            return
        if not safe.all():  # units of texts that are encoded whole are of no use
            words = np.repeat(safe, np.diff(ends, prepend=0))
            used = np.unique(coded.indices.to_numpy()[words])
            places = np.zeros(len(coded.dictionary), np.int64)
            places[used] = self._places(coded.dictionary.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist())
        else:
            places = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        yield from self._assembled(texts, safe, places[coded.indices.to_numpy()], ends)

    def _assembled(self, texts, safe, unit, ends):
        begins = np.concatenate([[0], ends[:-1]])
        size = self.size[unit] if len(unit) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        row, n = 0, len(texts)
        while row < n:
            if not safe[row]:
                last = row + 1
                while last < n and not safe[last] and last - row < 64:
                    last += 1
                yield from self._whole(texts.slice(row, last - row), np.arange(row, last))
                row = last
                continue
            last = int(np.searchsorted(total[ends], total[begins[row]] + IDS_AT_ONCE, side="right"))
            last = min(max(last, row + 1), n)
            unsafe = np.flatnonzero(~safe[row:last])
            if len(unsafe):
                last = row + int(unsafe[0])
            a, b = begins[row], ends[last - 1]
            start, length = self.start[unit[a:b]], size[a:b].copy()
            if self.mode == "kept":  # the line end that stands before every text is not of it
                first = begins[row:last] - a
                start[first] += 1
                length[first] -= 1
            stop = np.cumsum(length)
            ids = self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - length), length)]
            stop = np.concatenate([[0], stop])
            yield row, ids, stop[ends[row:last] - a]
            row = last

    def _whole(self, texts: pa.Array, rows: np.ndarray):
        for i, ids in zip(rows.tolist(), (self._plain([t.as_py()])[0] for t in texts)):
            yield i, np.asarray(ids, np.uint32), np.asarray([len(ids)])


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, special_as_text: bool = False) -> TextEncoder:
    """The worker's own encoder of the file; what it remembers serves later tasks."""
    if (path, special_as_text) not in _ENCODERS:
        _ENCODERS[path, special_as_text] = TextEncoder(path, special_as_text=special_as_text)
    return _ENCODERS[path, special_as_text]


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
