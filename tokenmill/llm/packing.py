"""Best-fit packing of token pieces into sequences by a configuration linear program.

1. ``token_pieces``: documents become pieces of at most ``capacity`` tokens (one pass
   over the text; only the narrow piece rows are kept).
2. ``plan_sequences``: a configuration is a multiset of lengths that fits a sequence.
   The linear program "fewest sequences whose configurations hold the length
   histogram" is solved by multiplicative weights: prices per length, the best
   configurations at these prices by an unbounded-knapsack dynamic program, prices of
   well-served lengths go down. The fractional solution is rounded down and what is
   left is packed best-fit decreasing. All of this sees only the histogram (at most
   ``capacity`` rows, whatever the corpus), so it runs on the driver.
3. ``pack``: the pieces of each length are numbered 0..n-1 by a distributed dense
   index, and piece r of length l takes slot r among the plan's slots of length l.

A document is never cut unless it is longer than a sequence. Null and empty texts are
one end id. Repeated rows are packed as the separate documents they are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.frames import map_batches, stored
from tokenmill.llm.tokens import encoder, tokenizer_path
from tokenmill.plans.index import dense_index_by_hash

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
# Most rounds of multiplicative weights (each one knapsack), their step, and the
# slack under the dearest configuration with which they begin.
ROUNDS = 200
STEP = 0.1
GAP = 0.0005


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False,
                 special_as_text: bool = False) -> DataFrame:
    """One row per piece: key, ``piece``, ``start`` (the document's ids before it),
    ``length``, ``ids_crc32`` and, if asked for, ``ids``. ``special_as_text``: strings of
    special tokens are ordinary text."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    kind = T._parse_datatype_string(docs.schema[key].dataType.simpleString())
    schema = T.StructType([T.StructField(key, kind), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids_crc32", T.LongType())]
                          + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, special_as_text)
        for batch in batches:
            keys = batch.column(0)
            for first, ids, ends in enc.encode(batch.column(1)):
                rows, piece, start, crc, parts = [], [], [], [], []
                begin = 0
                for row, end in enumerate(ends.tolist(), first):
                    doc = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    begin = end
                    for k, at in enumerate(range(0, len(doc), capacity)):
                        part = doc[at:at + capacity]
                        rows.append(row), piece.append(k), start.append(at), parts.append(part)
                        crc.append(zlib.crc32(part))
                cols = [keys.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(list(map(len, parts)), pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(parts, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return map_batches(docs, [key, text], schema, cut)


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the dearest filling of every room 0..capacity, and the
    position in ``lengths`` (ascending) of the one placed last (-1: a token left free)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            value = best[room - lengths[:fits[room]]] + prices[:fits[room]]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], last[room] = value[k], k
    return best, last


def _filling(last: np.ndarray, lengths: list[int], room: int) -> dict[int, int]:
    counts: dict[int, int] = {}
    while room > 0:
        k = int(last[room])
        if k < 0:
            room -= 1
        else:
            counts[k] = counts.get(k, 0) + 1
            room -= lengths[k]
    return counts


def solve_program(need: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, step: float = STEP,
                  gap: float = GAP) -> tuple[list[tuple[dict[int, int], float]], float]:
    """The covering program by multiplicative weights: ``(configuration, multiplicity)``
    and a lower bound on the number of sequences.

    A length's price is its size times a weight that falls exponentially with the
    share of its need already met; met lengths leave the program. At each round's
    prices the knapsack gives, for every open length, the dearest configuration that
    holds it; those within the round's slack of the dearest of all are taken as often
    as the open needs allow. Slack starts at ``gap`` and doubles when a round finds
    little, so dear (full) configurations always go first. Any prices divided by the
    dearest configuration's are feasible for the dual program, hence the bound."""
    open_ = {l: float(n) for l, n in need.items()}
    taken: dict[tuple, float] = {}
    bound = sum(l * n for l, n in need.items()) / capacity
    slack = gap
    for _ in range(rounds):
        lengths = np.array(sorted(open_), np.int64)
        if not len(lengths):
            break
        met = np.array([1 - open_[l] / need[l] for l in lengths.tolist()])
        prices = lengths * np.exp(-step * met) * (1 + lengths / capacity * step)
        best, last = knapsack(lengths, prices, capacity)
        bound = max(bound, float((prices * [need[l] for l in lengths.tolist()]).sum() / best[-1]))
        sizes, before = lengths.tolist(), sum(open_.values())
        for i in range(len(sizes) - 1, -1, -1):  # the longest first
            if sizes[i] not in open_ or prices[i] + best[capacity - sizes[i]] < (1 - slack) * best[-1]:
                continue
            counts = _filling(last, sizes, capacity - sizes[i])
            counts[i] = counts.get(i, 0) + 1
            if any(sizes[k] not in open_ for k in counts):
                continue
            amount = min(open_[sizes[k]] / c for k, c in counts.items())
            name = tuple(sorted((sizes[k], c) for k, c in counts.items()))
            taken[name] = taken.get(name, 0.0) + amount
            for length, c in name:
                open_[length] -= amount * c
                if open_[length] <= 1e-9 * need[length]:
                    del open_[length]
        if sum(open_.values()) > 0.9 * before:
            slack *= 2
    for length, n in open_.items():  # rounds ran out: the rest alone, for the rounding to mend
        taken[((length, capacity // length),)] = taken.get(((length, capacity // length),), 0.0) + n / (capacity // length)
    return [(dict(name), x) for name, x in taken.items()], bound


def _best_fit(lengths: list[tuple[int, int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over ``(length, count)``, longest first: configurations and
    how often each is used. Bins with the same room are one entry, so the work
    follows the distinct lengths, not the pieces."""
    rooms: dict[int, list[list]] = {}  # room left -> [configuration, bins]
    for length, count in sorted(lengths, reverse=True):
        while count:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                each = capacity // length
                full, rest = divmod(count, each)
                for n, k in ((full, each), (1, rest)):
                    if n and k:
                        rooms.setdefault(capacity - k * length, []).append([{length: k}, n])
                break
            config, bins = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            each = min(room // length, count)
            take = min(bins, count // each)
            new = config | {length: config.get(length, 0) + each}
            rooms.setdefault(room - each * length, []).append([new, take])
            if bins > take:
                rooms.setdefault(room, []).append([config, bins - take])
            count -= take * each
    return [(config, bins) for entries in rooms.values() for config, bins in entries]


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY, **how) -> list[tuple[dict[int, int], int]]:
    """Configurations ``{length: copies}`` with the number of sequences that use each;
    together they hold exactly the histogram. Multiplicities are rounded down and what
    is left goes best-fit; a best-fit of everything is taken if it needs fewer."""
    if not all(0 < l <= capacity for l in histogram):
        raise ValueError("a piece is longer than a sequence, or empty")
    whole = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    left = {l: n for l, n in histogram.items() if l < capacity and n}
    greedy = _best_fit(list(left.items()), capacity)
    plan = []
    for config, x in sorted(solve_program(left, capacity, **how)[0], key=lambda c: -c[1]):
        times = min([math.floor(x + 1e-6), *(left[l] // c for l, c in config.items())])
        if times:
            plan.append((config, times))
            for l, c in config.items():
                left[l] -= times * c
    plan += _best_fit([(l, n) for l, n in left.items() if n], capacity)
    return whole + min(plan, greedy, key=lambda p: sum(n for _, n in p))


def _slots(plan: Sequence[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as slot ranges, ordered by (length, first slot): slot s of the range
    is copy ``s % copies`` in sequence ``base + s // copies``."""
    rows, base, seen = [], 0, {}
    for config, times in plan:
        offset = 0
        for length in sorted(config, reverse=True):
            copies = config[length]
            rows.append((length, seen.get(length, 0), base, copies, offset))
            seen[length] = seen.get(length, 0) + times * copies
            offset += length * copies
        base += times
    rows.sort()
    names = ("length", "first", "base", "copies", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pack(pieces: DataFrame, keys: Sequence[str], capacity: int = CAPACITY, **how) -> DataFrame:
    """``pieces`` (any frame with a ``length`` of 1 to ``capacity``) plus
    ``sequence_id`` and ``offset`` (gapless from 0). ``keys`` tell rows of one length
    apart; rows equal in them are interchangeable. ``pieces`` is read twice, so hand
    in a stored table."""
    histogram = {int(r["length"]): int(r["n"]) for r in
                 pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots = _slots(plan_sequences(histogram, capacity, **how))
    shared = pieces.sparkSession.sparkContext.broadcast(slots)  # the histogram's size, not the corpus's
    keyed = pieces.withColumn("__order", F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("-"))
                                                                  for k in keys])))
    ranked = dense_index_by_hash(keyed, "__order", list(keys), ["length"], out="__rank", total=None).drop("__order")
    schema = T.StructType([f for f in pieces.schema if f.name not in ("sequence_id", "offset")]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = [f.name for f in schema][:-2]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        where = np.stack([s["length"], s["first"]], 1)
        starts = {int(l): int(i) for l, i in zip(*np.unique(where[:, 0], return_index=True))}
        bounds = np.append(np.array(sorted(starts.values()), np.int64), len(where))
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("__rank")).to_numpy()
            at = np.zeros(len(length), np.int64)
            for l in np.unique(length).tolist():
                own = length == l
                a = starts[l]
                b = int(bounds[np.searchsorted(bounds, a, side="right")])
                at[own] = a + np.searchsorted(where[a:b, 1], rank[own], side="right") - 1
            slot = rank - s["first"][at]
            copies = s["copies"][at]
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            cols += [pa.array(s["base"][at] + slot // copies), pa.array(s["offset"][at] + slot % copies * length)]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                   tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Whole documents to placed pieces; the pieces are stored in the shared folder
    once, so no text is encoded twice."""
    pieces = stored(token_pieces(docs, key, text, capacity, tokenizer, end_id, with_ids), "pieces")
    return pack(pieces, [key, "piece", "ids_crc32"], capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in place order, from pieces packed ``with_ids``
    (a sequence's ids are at most ``capacity``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
