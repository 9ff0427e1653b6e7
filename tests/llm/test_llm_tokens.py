import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001
from llm_data import awkward, awkward_rows, empty
from tokenizers import Tokenizer

from tokenmill.llm import packing, token_store, tokens
from tokenmill.llm.frames import scratch_path


def plain(name, special_as_text=False):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    if special_as_text:
        t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(tokens.SPACES))
@pytest.mark.parametrize("max_units,special_as_text", [(5, False), (100_000, False), (100_000, True)])
def test_encoder_equals_the_library(name, max_units, special_as_text):
    texts = [r[1] for r in awkward_rows()] * 2
    texts += ["it's 's a 12 1a", "a\nb c", "a\tb", "wor\u0308d \u0308x H\u0331", "ΑΣ ΣΑΣ", "a   b", "\n", "　", "\x01 a"]
    texts += ["alpha <|endoftext|> beta", "<|startoftext|>a<|endoftext|>", "<|ENDOFTEXT|> a", "a<|endoftext|", "<|endof text|>", "a\n<|endoftext|>\nb  c"]
    enc = tokens.TextEncoder(tokens.tokenizer_path(name), max_units, special_as_text)
    got = [None] * len(texts)
    for _ in range(2):
        for row, ids, ends in enc.encode(pa.array(texts)):
            for i, part in enumerate(np.split(ids, ends[:-1])):
                got[row + i] = part.tolist()
        assert got == [plain(name, special_as_text)(t) for t in texts]


@pytest.mark.parametrize("name", sorted(tokens.SPACES))
def test_encoder_remembers_no_unit_beyond_its_bound(name):
    texts = [f"alpha w{i}. beta{i}, W\u00e9{i}x 'tis{i}'s x{i}###" for i in range(40)]
    enc, encode = tokens.TextEncoder(tokens.tokenizer_path(name), 50), plain(name)
    used = []
    for _ in range(5):
        for row, ids, ends in enc.encode(pa.array(texts)):
            assert len(enc.index) <= 50
            for i, part in enumerate(np.split(ids, ends[:-1])):
                assert part.tolist() == encode(texts[row + i])
        used.append(len(enc.flat))
    assert len(enc.index) == 50 and used[-1] == used[-2]  # and room for the others is used again


def test_pieces_of_plain_words():
    words = ["", "abc", "abc.", "a,", ".", ",.", "a.b", "it's", "'s", "a1,", "12", "\u0130\u0130", "\u0130.", "\u00e9t\u00e9,", "a\u00d7,", "x,,", "a'"]
    assert [tokens._n_pieces(w) for w in words] == [len(tokens._PIECES(w.lower())) for w in words]


def check_pieces(rows, docs, capacity):
    """Every document whole and in order; every sequence gapless and within capacity."""
    encode = plain(packing.TOKENIZER)
    want = defaultdict(int)
    for key, text in docs:
        ids = encode(text) + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            want[(key, k, at, len(ids[at:at + capacity]), crc(ids[at:at + capacity]))] += 1
    got = defaultdict(int)
    for r in rows:
        got[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    assert got == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing_awkward_rows(spark):
    rows = packing.pack_documents(awkward(spark)).collect()
    check_pieces(rows, [(r[0], r[1]) for r in awkward_rows()], 2048)
    assert packing.pack_documents(empty(spark)).collect() == []


def test_packing_is_near_the_bound(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = packing.pack_documents(docs).collect()
    n = check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= 1.02 * sum(r.length for r in rows) / 2048 + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "ab cd " * (i + 1)) for i in range(30)], "doc_id long, text string")
    packed = packing.pack_documents(docs, capacity=64, with_ids=True)
    found = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert found[r.sequence_id][r.offset:r.offset + r.length] == r.ids


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_the_histogram_and_beats_best_fit(seed):
    rng = np.random.default_rng(seed)
    sizes = [rng.integers(1, 101, 500), rng.integers(30, 60, 2000), rng.choice([34, 35, 51, 50], 300), np.array([100, 1]),
             np.clip(rng.lognormal(3, 1, 5000).astype(int), 1, 100), np.array([], int)][seed]
    histogram = dict(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True))))
    plan = packing.plan_sequences(histogram, 100)
    back = defaultdict(int)
    for config, times in plan:
        assert sum(l * c for l, c in config.items()) <= 100
        for l, c in config.items():
            back[l] += times * c
    assert back == histogram
    assert sum(n for _, n in plan) <= sum(n for _, n in packing._best_fit(list(histogram.items()), 100))
    _, bound = packing.solve_program({l: n for l, n in histogram.items() if l < 100}, 100)
    assert sum(n for _, n in plan) >= bound - 1e-6


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(3)
    lengths, prices = np.array([3, 5, 7, 11]), rng.random(4)
    best, _ = packing.knapsack(lengths, prices, 40)
    worth = [0.0] * 41
    for room in range(1, 41):
        worth[room] = max([worth[room - 1]] + [worth[room - l] + p for l, p in zip(lengths, prices) if l <= room])
    assert np.allclose(best, worth)


@pytest.mark.parametrize("n", [0, 1, 7, 1000, 30_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10**12, n, replace=False) - 10**11
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))


def test_store_round_trip(spark):
    docs = awkward(spark)
    path = token_store.write_store(docs, scratch_path(spark, "store"), n_shards=3, n_parts=2)
    encode = plain(token_store.TOKENIZER)
    want = sorted((r[0] is not None, r[0] or 0, crc(encode(r[1]) + [0]), len(encode(r[1])) + 1) for r in awkward_rows())
    rows = token_store.fetch(spark, path, docs.select("doc_id"), with_ids=True).unionByName(
        token_store.fetch(spark, path, with_ids=True)).collect()
    assert sorted((r.key is not None, r.key or 0, r.ids_crc32, r.n_tokens) for r in rows) == want
    assert all(crc(r.ids) == r.ids_crc32 for r in rows)
    start = 0
    for r in sorted(rows, key=lambda r: r.start):  # gapless, null keys first, then ascending
        assert r.start == start
        start += r.n_tokens
    keys = [r.key for r in sorted(rows, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    store = token_store.TokenStore(path)
    assert sorted(len(x) for x in store.get(1)) == sorted(len(encode(r[1])) + 1 for r in awkward_rows() if r[0] == 1)
    assert store.get(2)[0].tolist() == encode(awkward_rows()[3][1]) + [0]
    assert store.get(99) == [] and store.get(-5) == []


def test_store_of_nothing(spark):
    path = token_store.write_store(empty(spark), scratch_path(spark, "store"))
    assert token_store.fetch(spark, path, empty(spark).select("doc_id")).count() == 0
    assert token_store.fetch(spark, path).count() == 0
