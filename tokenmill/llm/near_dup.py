"""Near-duplicate groups by BagMinHash.

A text is the multiset of its five-word shingles (words as in ``decontaminate``; fewer
than five words are one shingle). Similarity is the weighted Jaccard of the multisets.

Signatures: the weight of a shingle, its count, lives on a scale cut at the integers
and grouped into intervals [0,1), [1,2), [2,4), [4,8) ... Each (shingle, interval) has
a Poisson process whose rate is the interval's length; an event has a time, a register
and a place on the scale, all drawn from hashes, and counts if its place lies under the
weight. A register's value is its earliest event, so two texts agree in a register
with a chance of exactly their weighted Jaccard. Processes stop once their time is past
the latest register, so a text costs about as many events as it has shingles, whatever
the signature's length.

Candidates: signatures are cut into ``BANDS`` bands of ``ROWS`` registers; texts that
agree in a band share a bucket (a pair at 0.8 is missed with a chance of 1.5e-4, one
at 0.85 of 2.4e-7, and one at 0.3, as a shared passage makes, meets with one of 0.3 %).
Equal texts are one node first, so a group of copies costs one signature per task that
reads it. Then

1. a few bands at a time (``ROUNDS``), a bucket's members of different components, one
   per component, are paired with its most central one (whose buckets hold the most
   members), the pairs verified by exact multiset overlap, and the links' components
   found. The text that a group was copied from is the most central, so the group
   collapses in the first bands and its many buckets in the later ones emit nothing;
2. pairs of one bucket that are still in different components are verified too. Where
   these would be more than ``CROSS`` times the bucket's members (texts that share a
   long common passage), the members are met by an exact filter instead: shingles are
   ordered by how many such texts hold them (counted exactly), two similar texts share
   one of the first ``1 - similarity`` of their shingles, and a common passage is at the
   end of that order. Components whose members so meet are compared by their pivots:
   the distance ``1 - similarity`` is a metric, so with every member's distance to its
   own pivot known, the distance of two pivots bounds that of any two members from
   below. Members whom it leaves are compared tile by tile (many of either component in
   one group), each with all that are left of the other; one link of a member is enough.
   No link between components is lost, in whatever buckets its texts are, and no bucket
   is capped.

Only texts that share a bucket are shuffled, once, to write their bags of shingles; all
that follows joins bags by node.

Every text is a row of the result. Texts without words equal each other; a null text
is a group of its own. A class is named by its least key; null keys come last. Very long
texts are signed whole, one at a time. An empty table gives no rows. The caller's other
columns, whatever their names, pass through ``keep_one`` unchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.llm.components import connected_components
from tokenmill.llm.decontaminate import _NORMAL
from tokenmill.llm.frames import frugal, map_batches, stored, text_chunks
from tokenmill.llm.subwords import WordBatch

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 48, 8
# Pairs across components that a bucket may emit for each of its members.
CROSS = 8
# Bands whose buckets are contracted together: up to each of these, then the rest.
ROUNDS = (4,)
# Shared shingles of such texts that are broadcast (16 bytes each); more are joined.
BROADCAST = 1 << 20
# Shingles of a tile of texts that are compared with those of another tile (8 bytes each).
TILE = 1 << 16
# Bytes of text, and texts, that a task signs at a time (a text has a row of registers of its own).
SIGN_BYTES, SIGN_ROWS = 1 << 19, 1 << 10
# Bytes of bags that a task compares or counts at a time.
BAG_BYTES = 1 << 20
# Room for rounding in bounds of distances.
SLACK = 1e-9
_GOLD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """``(text, hash)`` of every shingle, and a 128-bit digest of each text's words
    (None for a null text)."""
    normal = [t.encode("utf-8", "surrogatepass").translate(_NORMAL) if t else b"" for t in texts]
    words = WordBatch(pa.array(normal, pa.binary()).view(pa.string()))
    hashed = np.fromiter([xxhash.xxh3_64_intdigest(w) for w in words.words], np.uint64, len(words.words))
    w = hashed[words.word] if len(words.word) else np.zeros(0, np.uint64)
    begins = np.concatenate([[0], words.ends[:-1]]) if len(words.ends) else words.ends
    digests = [None if t is None else hashlib.md5(w[a:b].data).digest()
               for t, a, b in zip(texts, begins.tolist(), words.ends.tolist())]
    with np.errstate(over="ignore"):
        last = max(0, len(w) - size + 1)
        h = np.zeros(last, np.uint64)
        for i in range(size):
            h = _mixed(h * np.uint64(31) + w[i:i + last])
        inside = words.doc[:last] == words.doc[size - 1:] if last else np.zeros(0, bool)
        doc, h = words.doc[:last][inside], h[inside]
        count = words.ends - begins
        for d in np.flatnonzero((count > 0) & (count < size)).tolist():  # one shingle of all its words
            x = np.zeros(1, np.uint64)
            for v in w[begins[d]:words.ends[d]]:
                x = _mixed(x * np.uint64(31) + v)
            doc, h = np.append(doc, d), np.append(h, x + np.uint64(count[d]))
    return doc, h, digests


def bags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(text, hash)`` with their counts, by text and hash."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(doc) else np.zeros(0, int)
    return doc[first], h[first], np.diff(np.append(first, len(doc)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """A row of event times per text (infinite for a text without shingles)."""
    level = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # intervals 0..level meet the weight
    owner = np.repeat(np.arange(len(h)), level + 1)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(level + 1) - (level + 1), level + 1)
    low = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0)
    length = np.maximum(low, 1)
    under = np.minimum(weight[owner] - low, length)
    with np.errstate(over="ignore"):
        seed = _mixed(h[owner] + k.astype(np.uint64) * np.uint64(_GOLD))
    text, time, event = doc[owner], np.zeros(len(owner)), 0
    out = np.full(n * registers, np.inf)
    latest = np.full(n, np.inf)
    while len(seed):
        with np.errstate(over="ignore"):
            x = _mixed(seed + np.uint64((event + 1) * _GOLD % 2**64))
            y = _mixed(x ^ np.uint64(0xD6E8FEB86659FD93))
        time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
        event += 1
        place = ((y & np.uint64(0xFFFFFFFF)) * length.astype(np.uint64)) >> np.uint64(32)
        counts = (time < latest[text]) & (place.astype(np.int64) < under)
        register = ((y >> np.uint64(32)) * np.uint64(registers)) >> np.uint64(32)
        np.minimum.at(out, text[counts] * registers + register[counts].astype(np.int64), time[counts])
        latest = out.reshape(n, registers).max(1)
        go = time < latest[text]
        seed, text, time, length, under = seed[go], text[go], time[go], length[go], under[go]
    return out.reshape(n, registers)


def band_hashes(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit value per text and band; single precision, so that machines whose
    logarithms differ in the last bit agree."""
    bits = times.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(times), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40), bits.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = _mixed(out * np.uint64(31) + bits[:, :, i])
    return out.view(np.int64)


def _sign(bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a text is signed once per task, however many copies of it are read
        for whole in batches:
            for batch in text_chunks(whole, "text", SIGN_BYTES, SIGN_ROWS):
                texts = batch.column("text").to_numpy(zero_copy_only=False).tolist()
                doc, h, digests = shingles(texts)
                own = np.zeros(len(texts), bool)
                for i, n in enumerate(digests):
                    if n is not None and n not in seen:
                        seen.add(n)
                        own[i] = True
                place = np.cumsum(own) - 1
                keep = own[doc]
                d, g, c = bags(place[doc[keep]], h[keep])
                values = band_hashes(signatures(d, g, c, int(own.sum()), bands * rows), bands, rows)
                ends = pa.array(np.append(0, np.cumsum(own) * bands).astype(np.int32), mask=np.append(~own, False))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), batch.column("t"), pa.array(digests, pa.binary()),
                     pa.array(np.bincount(doc, minlength=len(texts))), pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))],
                    ["key", "t", "node", "size", "bands"])

    return sign


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_chunks(whole, "text", SIGN_BYTES):
            doc, h, digests = shingles(batch.column("text").to_numpy(zero_copy_only=False).tolist())
            size = np.bincount(doc, minlength=len(digests))
            d, g, c = bags(doc, h)
            at = np.searchsorted(d, np.arange(len(digests) + 1))
            bag = [(g[a:b].tobytes(), c[a:b].astype(np.int32).tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(size), pa.array([x for x, _ in bag], pa.binary()),
                 pa.array([x for _, x in bag], pa.binary())], ["node", "size", "hashes", "counts"])


def overlap(ha: bytes, ca: bytes, hb: bytes, cb: bytes) -> float:
    """Weighted Jaccard of two bags."""
    x, m, y, n = np.frombuffer(ha, np.uint64), np.frombuffer(ca, np.int32), np.frombuffer(hb, np.uint64), np.frombuffer(cb, np.int32)
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(m[i], n[j]).sum())
    return common / max(1, int(m.sum()) + int(n.sum()) - common)


def _compared(most: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, "hu", BAG_BYTES):
                cols = [batch.column(i).to_pylist() for i in range(6)]
                found = [(i, 1 - overlap(ha, ca, hb, cb)) for i, (_, _, ha, ca, hb, cb) in enumerate(zip(*cols))]
                keep = [x for x in found if x[1] <= most]
                at = pa.array([i for i, _ in keep], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([d for _, d in keep], pa.float64())],
                                                 ["u", "v", "d"])

    return check


def _distances(pairs: DataFrame, bag: DataFrame, most: float = 2.0) -> DataFrame:
    """``u, v, d``: the distances of the ``pairs`` (u, v) that are at most ``most``."""
    a = bag.select(F.col("node").alias("u"), F.col("hashes").alias("hu"), F.col("counts").alias("cu"))
    b = bag.select(F.col("node").alias("v"), F.col("hashes").alias("hv"), F.col("counts").alias("cv"))
    met = pairs.select("u", "v").distinct().join(a, "u").join(b, "v").select("u", "v", "hu", "cu", "hv", "cv")
    return met.mapInArrow(frugal(_compared(most)), "u binary, v binary, d double")


def _links(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (u, v) whose texts are similar."""
    return _distances(pairs, bag, 1 - similarity + SLACK).select("u", "v")


def _copies(h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multisets as sets: the place in ``h`` and a hash of each copy of each shingle."""
    owner = np.repeat(np.arange(len(h)), weight)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return owner, _mixed(h[owner] + k.astype(np.uint64) * np.uint64(_GOLD))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per copy of each shingle of a bag."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            _, copy = _copies_of(one["hashes"][0].as_py(), one["counts"][0].as_py())
            at = pa.array(np.zeros(len(copy), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(copy.view(np.int64)), one["node"].take(at), one["root"].take(at), one["size"].take(at)],
                ["shingle", "node", "root", "size"])


def _copies_of(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return _copies(np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int32))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many bags of some rows hold each copy of each shingle."""
    for whole in batches:
        for batch in text_chunks(whole, "hashes", BAG_BYTES):
            copies = [_copies_of(h, c)[1] for h, c in zip(batch["hashes"].to_pylist(), batch["counts"].to_pylist())]
            shingle, n = np.unique(np.concatenate(copies) if copies else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(n.astype(np.int64))], ["shingle", "n"])


def _leads(size: np.ndarray, place: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which places of texts of a ``size`` are of their prefix, and which of these lead."""
    room = size - place + 1e-6  # at most so much overlap, if this is the first shingle shared
    return room >= similarity * size, room >= 2 * similarity / (1 + similarity) * size


def _prefix_rows(shared, similarity: float):
    """``shared``: a broadcast of the sorted shingles that more texts have, and their counts."""
    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value
        for batch in (part for whole in batches for part in text_chunks(whole, "hashes", BAG_BYTES)):
            parts = []
            for i, (h, c) in enumerate(zip(batch["hashes"].to_pylist(), batch["counts"].to_pylist())):
                copy = _copies_of(h, c)[1].view(np.int64)
                at = np.minimum(np.searchsorted(known, copy), max(len(known) - 1, 0))
                met = known[at] == copy if len(known) else np.zeros(len(copy), bool)
                own, n = copy[met], counts[at[met]] if len(known) else np.zeros(0, np.int64)
                order = np.lexsort((own, n))
                place = len(copy) - len(own) + np.arange(len(own))
                keep, lead = _leads(np.float64(len(copy)), place, similarity)
                parts.append((np.full(int(keep.sum()), i), own[order][keep], lead[keep]))
            row, shingle, lead = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, int),) * 3
            at = pa.array(row.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingle.astype(np.int64)), batch["node"].take(at), batch["root"].take(at), batch["size"].take(at),
                 pa.array(lead.astype(bool))], ["shingle", "node", "root", "size", "lead"])

    return prefix


def _prefixes(texts: DataFrame, similarity: float, broadcast: int = BROADCAST) -> DataFrame:
    """The shingles of each of the ``texts`` (node, root, size, hashes, counts) by which a
    similar one must meet it, rarest first: ``shingle, node, root, size, lead``.
    ``lead``: those by which it meets a text of its own size or larger. Shingles of one
    text alone come first in its order and are left out.

    Shared shingles with their counts are broadcast up to ``broadcast`` of them, so only
    prefixes leave a task; beyond, all shingles are joined with their counts."""
    texts = texts.select("node", "root", "size", "hashes", "counts")
    shared = texts.select("hashes", "counts").mapInArrow(frugal(_counted), "shingle bigint, n bigint")
    shared = stored(shared.groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1"), "shared-shingles")
    if shared.count() <= broadcast:
        table = shared.toArrow()
        order = np.argsort(table["shingle"].to_numpy())
        known = texts.sparkSession.sparkContext.broadcast((table["shingle"].to_numpy()[order], table["n"].to_numpy()[order]))
        return texts.mapInArrow(frugal(_prefix_rows(known, similarity)), "shingle bigint, node binary, root binary, size bigint, lead boolean")
    rows = stored(texts.mapInArrow(frugal(_shingle_rows), "shingle bigint, node binary, root binary, size bigint"), "shingles")
    text = Window.partitionBy("node")
    alone = F.col("size") - F.count(F.lit(1)).over(text)
    place = alone + F.row_number().over(text.orderBy("n", "shingle")) - 1
    room = F.col("size") - F.col("place") + 1e-6
    placed = rows.join(shared, "shingle").withColumn("place", place).where(room >= F.lit(similarity) * F.col("size"))
    lead = room >= F.lit(2 * similarity / (1 + similarity)) * F.col("size")
    return placed.select("shingle", "node", "root", "size", lead.alias("lead"))


def _across(left: DataFrame, right: DataFrame, on: str, roots: str) -> DataFrame:
    """Rows of ``left`` and ``right`` (``on, node, root, ..``, named with 1 and 2) that
    agree in ``on`` and whose roots are as ``roots`` says. Roots meet first, so that a
    large component isn't joined with itself."""
    one = left.select(on, *[F.col(c).alias(f"{c}1") for c in left.columns if c != on])
    two = right.select(on, *[F.col(c).alias(f"{c}2") for c in right.columns if c != on])
    met = one.select(on, "root1").distinct().join(two.select(on, "root2").distinct(), on).where(roots)
    return met.join(one, [on, "root1"]).join(two, [on, "root2"])


def _filtered(hot: DataFrame, bag: DataFrame, similarity: float, broadcast: int = BROADCAST) -> DataFrame:
    """Pairs of ``hot`` texts (node, root) of different roots: of two components with similar
    texts there is one pair of such at least."""
    texts = stored(hot.join(bag, "node"), "hot-bags")
    prefixes = stored(_prefixes(texts, similarity, broadcast), "prefixes")
    # classes of size one ratio wide: a text meets larger ones of its own class and the next
    classed = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(similarity)) + 1e-9).cast("int")
    lead = prefixes.where("lead").select("shingle", "root", F.explode(F.array(classed, classed + 1)).alias("class")).distinct()
    rest = prefixes.select("shingle", "root", classed.alias("class")).distinct()
    met = lead.join(rest.withColumnRenamed("root", "other"), ["shingle", "class"]).where("root <> other")
    pivots = met.select(F.least("root", "other").alias("u"), F.greatest("root", "other").alias("v")).distinct()
    # the distance of pivots, and of members to their own
    apart = stored(_distances(pivots, bag), "pivot-distances")
    most = 1 - similarity + SLACK
    linked = apart.where(F.col("d") <= most).select("u", "v")
    own = _distances(texts.where("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v")), bag)
    members = texts.select("node", "root", "size").join(own.select(F.col("v").alias("node"), F.col("d").alias("off")), "node", "left")
    members = stored(members.withColumn("off", F.coalesce("off", F.lit(0.0))), "hot-members")
    reach = members.groupBy("root").agg(F.max("off").alias("reach"), F.sum("size").alias("all"))
    left = reach.select(F.col("root").alias("u"), F.col("reach").alias("ru"), F.col("all").alias("au"))
    right = reach.select(F.col("root").alias("v"), F.col("reach").alias("rv"), F.col("all").alias("av"))
    open_ = apart.where(F.col("d") > most).join(left, "u").join(right, "v").where(F.col("d") - F.col("ru") - F.col("rv") <= most)
    larger = F.col("au") >= F.col("av")
    host = F.when(larger, F.struct(F.col("u").alias("root"), F.col("ru").alias("reach"), F.col("v").alias("other")))
    sides = stored(open_.select("d", host.otherwise(F.struct(F.col("v").alias("root"), F.col("rv").alias("reach"), F.col("u").alias("other"))).alias("s"))
                   .select("s.*", "d"), "sides")
    return linked.unionByName(_hosted(sides, members.join(bag.select("node", "hashes", "counts"), "node"), similarity))


def _hosted(sides: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs of ``texts`` (node, root, size, off, hashes, counts) of the components of ``sides``
    (root, reach, other, d): for each text of ``other`` that has a similar one in ``root``,
    one such at least.

    Texts of ``root`` (hosts) and those that it is to be compared with (guests) are dealt
    into tiles of about ``TILE`` shingles, and a tile meets a tile in one group: a text is
    shuffled once for each tile that it meets, not once for each text, and of all the pairs
    that a group compares, it gives one for a guest at most."""
    most = 1 - similarity + SLACK
    texts = stored(texts, "hosted-texts")
    guests = sides.join(texts.withColumnRenamed("root", "other"), "other").where(F.col("d") - F.col("off") - F.col("reach") <= most)
    guests = stored(guests.select("root", "node", "size", "hashes", "counts"), "guests")
    hosts = texts.join(sides.select("root").distinct(), "root").select("root", "node", "size", "hashes", "counts")
    tiles = lambda rows, n: rows.groupBy("root").agg(F.ceil(F.sum("size") / F.lit(TILE)).cast("int").alias(n))
    dealt = tiles(hosts, "a").join(tiles(guests, "b"), "root")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = hosts.join(dealt, "root").select("root", own("a").alias("i"), each("b").alias("j"), F.lit(True).alias("host"), "node", "hashes", "counts")
    right = guests.join(dealt, "root").select("root", each("a").alias("i"), own("b").alias("j"), F.lit(False).alias("host"), "node", "hashes", "counts")
    found = left.unionByName(right).groupBy("root", "i", "j").applyInArrow(_best_hosts(similarity), "a binary, b binary")
    return found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _best_hosts(similarity: float):
    def best(rows: pa.Table) -> pa.Table:
        host = rows["host"].to_numpy()
        node = rows["node"].to_pylist()
        bag = [_copies_of(h, c)[1] for h, c in zip(rows["hashes"].to_pylist(), rows["counts"].to_pylist())]
        hosts, guests = np.flatnonzero(host), np.flatnonzero(~host)
        a, b = [], []
        if len(hosts) and len(guests):
            size = np.array([len(bag[i]) for i in hosts])
            shingle, owner = np.concatenate([bag[i] for i in hosts]), np.repeat(np.arange(len(hosts)), size)
            order = np.argsort(shingle)
            shingle, owner = shingle[order], owner[order]
            for g in guests.tolist():
                first, end = np.searchsorted(shingle, bag[g], "left"), np.searchsorted(shingle, bag[g], "right")
                n = end - first
                at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                common = np.bincount(owner[at], minlength=len(hosts))
                alike = common / np.maximum(1, size + len(bag[g]) - common)
                k = int(alike.argmax())
                if alike[k] >= similarity - SLACK:
                    a.append(node[hosts[k]])
                    b.append(node[g])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return best


def _cross(members: DataFrame, bag: DataFrame, similarity: float, cross: int) -> DataFrame:
    """Pairs of ``members`` (bucket, node, size, root) of one bucket and different roots; in
    the buckets that would emit too many, those that the exact filter leaves."""
    counts = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    sums = sums.where("n * n > squares").withColumn(
        "hot", (F.col("n") * F.col("n") - F.col("squares")) / 2 > cross * F.col("n"))
    open_ = stored(members.join(sums.select("bucket", "hot"), "bucket"), "open-buckets")
    cold = open_.where(~F.col("hot")).select("bucket", "node", "size", "root")
    met = _across(cold, cold, "bucket", "root1 < root2").where(_sizes_allow(F.col("size1"), F.col("size2"), similarity))
    pairs = met.select(F.least("node1", "node2").alias("u"), F.greatest("node1", "node2").alias("v"))
    hot = stored(open_.where("hot").select("node", "root").distinct(), "hot")
    if hot.limit(1).count():
        pairs = pairs.union(_filtered(hot, bag, similarity))
    return pairs.distinct()


def _sizes_allow(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) >= F.lit(similarity) * F.greatest(a, b)


def _with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with the component (node, root) that each is in so far."""
    if roots is None:
        return members.withColumn("root", F.col("node"))
    rooted = members.join(roots, "node", "left")
    return stored(rooted.withColumn("root", F.coalesce("root", "node")), "rooted")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, root) so far, with those that the ``links`` join made one."""
    if roots is not None:  # a component is linked by its members' roots as well as by all its links
        links = links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return connected_components(links)


def _stars(members: DataFrame, similarity: float) -> DataFrame:
    """In each bucket of ``members`` (bucket, node, size, degree, root) the most central one of
    every other component, paired with the most central of all."""
    ends = members.groupBy("bucket", "root").agg(F.max(F.struct("degree", "node", "size")).alias("end"))
    pivots = ends.groupBy("bucket").agg(F.max(F.struct("end", "root")).alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = ends.join(pivots, "bucket").where("root <> pivot.root").where(
        _sizes_allow(F.col("end.size"), F.col("pivot.end.size"), similarity))
    return met.select(F.least("pivot.end.node", "end.node").alias("u"), F.greatest("pivot.end.node", "end.node").alias("v"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
           bands: int = BANDS, rows: int = ROWS, cross: int = CROSS) -> DataFrame:
    """``key, t`` (md5 of the text) and ``class_key`` and ``class_t`` of the text that
    stands for its group, for every row of ``docs``."""
    texts = docs.select(F.col(key).alias("key"), F.md5(F.col(text)).alias("t"), F.col(text).alias("text"))
    signed = stored(map_batches(texts, ["key", "t", "text"], f"key {docs.schema[key].dataType.simpleString()}, t string, "
                                "node binary, size bigint, bands array<bigint>", _sign(bands, rows)), "signatures")
    nodes = stored(signed.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct(F.col("key").isNull().alias("no"), "key", "t")).alias("first"), F.any_value("size").alias("size"),
        F.any_value("bands", True).alias("bands")).select("node", "first.key", "first.t", "size", "bands"), "nodes")
    buckets = nodes.where("size > 0").select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(buckets.join(shared, "bucket"), "buckets")
    degrees = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = stored(members.drop("n").join(degrees, "node"), "central-buckets")
    mark = F.struct("key", "t").alias("mark")  # structs hold null keys equal
    met = nodes.join(members.select("node").distinct(), "node", "left_semi").select(mark)
    bag = map_batches(texts.select(mark, "text").join(met, "mark", "left_semi"), ["text"],
                      "node binary, size bigint, hashes binary, counts binary", _bag_rows)
    bag = stored(bag.dropDuplicates(["node"]), "bags")
    roots = None
    for first, end in zip((0, *ROUNDS), (*ROUNDS, bands)):
        some = _with_roots(members.where(F.col("band").between(first, end - 1)), roots)
        roots = _joined(roots, _links(_stars(some, similarity), bag.drop("size"), similarity))
    more = _links(_cross(_with_roots(members, roots), bag, similarity, cross), bag.drop("size"), similarity)
    roots = _joined(roots, more)
    rooted = nodes.join(roots, "node", "left").select("node", "key", "t", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("no"), "key", "t")).alias("first"))
    classes = rooted.join(named, "root").select("node", F.col("first.key").alias("class_key"), F.col("first.t").alias("class_t"))
    known = signed.where("node IS NOT NULL").select("key", "t", "node").join(classes, "node").select("key", "t", "class_key", "class_t")
    return known.unionByName(signed.where("node IS NULL").select("key", "t", F.col("key").alias("class_key"), F.col("t").alias("class_t")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; null texts all stay."""
    found = stored(groups(docs, key, text, **how), "classes")
    same = F.col("key").eqNullSafe(F.col("class_key")) & (F.col("t") == F.col("class_t"))
    keepers = found.where(same).groupBy("key", "t").agg(F.count(F.lit(1)).alias("n"))
    keepers = keepers.select(F.struct("key", "t").alias("mark"), "n")  # structs hold null keys equal
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(key).alias("key"), F.md5(F.col(text)).alias("t")).alias("mark"))
    kept = rows.join(keepers, "mark")
    repeated = keepers.where("n > 1").limit(1).count()
    alone = kept.where("n = 1") if repeated else kept
    out = alone.select("row.*").unionByName(docs.where(F.col(text).isNull()))
    if repeated:  # rows equal in key and text: any one of them
        out = out.unionByName(kept.where("n > 1").dropDuplicates(["mark"]).select("row.*"))
    return out
