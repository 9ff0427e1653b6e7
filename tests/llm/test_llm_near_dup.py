import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from conftest import SF001
from llm_data import awkward, awkward_rows, empty, words
from pyspark.sql import functions as F

import corpus_pipeline
from tokenmill.llm import near_dup


def plain_classes(docs, similarity=0.8):
    """Least key of each component of links between texts, by all pairs."""
    bags = [Counter(near_dup.shingles([t])[1].tolist()) if t is not None else None for _, t in docs]
    equal = [near_dup.shingles([t])[2][0] for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(range(len(docs)), 2):
        if bags[a] is None or bags[b] is None:
            continue
        common, total = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
        if equal[a] == equal[b] or (total and common >= similarity * total):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    keys = defaultdict(list)
    for i, (k, _) in enumerate(docs):
        keys[find(i)].append(k)
    return sorted(((k, min((x for x in keys[find(i)] if x is not None), default=None)) for i, (k, _) in enumerate(docs)), key=str)


def edited(text, n, seed):
    rng, ws = np.random.default_rng(seed), text.split()
    for i in rng.choice(len(ws), n, replace=False):
        ws[i] = f"q{seed}x{i}"
    return " ".join(ws)


def corpus():
    """Exact copies, near copies at many distances, chains, and texts that share a passage."""
    base = [words(150, s) for s in range(4)]
    rows = [base[0]] * 6 + [edited(base[1], n, n * 10 + s) for n in (0, 1, 2, 3, 4, 6, 9) for s in range(4)]
    chain = base[2]
    for s in range(8):
        rows.append(chain)
        chain = edited(chain, 2, 500 + s)
    passage = words(60, 77)
    rows += [words(50, 900 + s) + " " + passage for s in range(20)]
    rows += [base[3].upper(), base[3].replace(" ", ",  "), "a b", "a b", "A, b", "", "   ", "!!", None, None]
    return list(enumerate(rows))


@pytest.mark.parametrize("cross", [near_dup.CROSS, 0])
def test_groups_equal_all_pairs(spark, cross):
    """Also when every bucket's members go through the exact filter (cross = 0)."""
    docs = corpus()
    got = near_dup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), cross=cross)
    assert sorted(((r.key, r.class_key) for r in got.collect()), key=str) == plain_classes(docs)


def test_large_buckets_lose_no_pair(spark):
    """Pairs just above the limit whose common buckets all texts share by a passage."""
    passage, docs = words(240, 1, 10**6), []
    for s in range(60):
        own = words(60, 100 + s, 10**6).split()
        docs += [" ".join(own) + " " + passage, " ".join(own[:34] + words(26, 200 + s, 10**6).split()) + " " + passage]
    docs = list(enumerate(docs))
    assert len({c for _, c in plain_classes(docs)}) == 60
    got = near_dup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), bands=6, rows=2)
    assert sorted(((r.key, r.class_key) for r in got.collect()), key=str) == plain_classes(docs)


def test_a_large_component_is_not_joined_with_itself(spark):
    """100,000 texts of one component and two others in a bucket: 200,001 pairs, not 10^10."""
    n, began = 100_000, time.monotonic()
    node = F.encode(F.col("id").cast("string"), "UTF-8")
    members = spark.range(n + 2).select(F.lit(1).cast("long").alias("bucket"), node.alias("node"), F.lit(9).cast("long").alias("size"), F.when(
        F.col("id") < n, F.encode(F.lit("0"), "UTF-8")).otherwise(node).alias("root"))
    pairs = near_dup._cross(members, None, near_dup.SIMILARITY, near_dup.CROSS)
    assert pairs.count() == 2 * n + 1
    assert time.monotonic() - began < 40


def test_a_group_of_near_copies_emits_few_pairs(spark, monkeypatch):
    """As many pairs as members in the first bands, and hardly any in the many later ones."""
    emitted = []
    plain = near_dup._links
    monkeypatch.setattr(near_dup, "_links", lambda pairs, *a: emitted.append(pairs.distinct().count()) or plain(pairs, *a))
    text = words(200, 5)
    docs = [(i, edited(text, 1 + i % 2, i)) for i in range(600)]
    got = near_dup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r.class_key for r in got} == {0}
    assert sum(emitted) < 4 * len(docs), emitted


def test_rows_of_the_exact_filter_follow_its_texts(spark):
    """Texts of 60 own words and a passage of 240: their own shingles come first in the
    order and meet nothing, so neither prefixes nor pairs grow with the number of texts."""
    passage = words(240, 1, 10**6)
    for n in (100, 400):
        texts = [f"{words(60, 10 + s, 10**6)} {passage}" for s in range(n)]
        doc, h, nodes = near_dup.shingles(texts)
        d, g, c = near_dup.bags(doc, h)
        rows = [(nodes[i], nodes[i], int((doc == i).sum()), g[d == i].tobytes(), c[d == i].astype(np.int32).tobytes()) for i in range(n)]
        bag = spark.createDataFrame(rows, "node binary, root binary, size long, hashes binary, counts binary").repartition(4)
        for broadcast in (0, near_dup.BROADCAST):
            assert near_dup._prefixes(bag, 0.8, broadcast).where("lead").count() == 0
        assert near_dup._filtered(bag.select("node", "root"), bag.drop("root"), 0.8).count() == 0


def test_prefixes_are_the_same_by_broadcast_and_by_join(spark):
    texts = [edited(words(120, s % 3), 1 + s % 7, s) for s in range(40)] + ["a a a a a a a a a a a a", "b b b b b b a a a a a a a a"]
    doc, h, nodes = near_dup.shingles(texts)
    d, g, c = near_dup.bags(doc, h)
    rows = [(nodes[i], nodes[i], int((doc == i).sum()), g[d == i].tobytes(), c[d == i].astype(np.int32).tobytes()) for i in range(len(texts))]
    bag = spark.createDataFrame(rows, "node binary, root binary, size long, hashes binary, counts binary").repartition(3)
    one, two = (sorted(map(tuple, near_dup._prefixes(bag, 0.8, b).collect())) for b in (0, near_dup.BROADCAST))
    assert one == two and len(one) > 100


def test_components_meet_by_their_pivots(spark):
    """Members far from their pivots on the sides that face each other are still paired,
    and components out of reach are not."""
    base = words(200, 3).split()
    def at(i):  # texts along a line: each a few words on from the one before
        return " ".join(f"z{k}" if k < 2 * i else w for k, w in enumerate(base))
    docs = [(i, at(i)) for i in range(0, 60, 4)] + [(1000 + i, words(200, 900 + i)) for i in range(20)]
    for cross in (0, near_dup.CROSS):
        got = near_dup.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), cross=cross).collect()
        assert sorted(((r.key, r.class_key) for r in got), key=str) == plain_classes(docs)


def test_links_found_of_all_links_of_a_query_set(spark):
    """Ids divisible by 5 against all rows: every pair at 0.8 or more shares a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bags = {i: Counter(near_dup.shingles([t])[1].tolist()) for i, t in rows if t}
    of = {r.key: r.class_key for r in near_dup.groups(docs).collect()}
    links = []
    for i in (i for i in bags if i % 5 == 0):  # holds those divisible by 50
        for j in bags:
            common = sum((bags[i] & bags[j]).values())
            if i != j and common and common >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - common):
                links.append(of[i] == of[j])
    assert len(links) >= 20 and sum(links) / len(links) >= 0.9, (sum(links), len(links))


def test_callers_columns_may_have_any_name(spark):
    names = ["key", "t", "node", "n", "mark", "row", "__key", "__t", "__n", "first", "size", "bands"]
    docs = spark.createDataFrame([(i, words(40, i % 3), *range(len(names))) for i in range(9)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(i, words(40, i), *range(len(names))) for i in range(3)]


def test_groups_take_awkward_rows(spark):
    got = near_dup.groups(awkward(spark)).collect()
    assert sorted(((r.key, r.class_key) for r in got), key=str) == plain_classes([(r[0], r[1]) for r in awkward_rows()])
    kept = near_dup.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns
    texts = [r.text for r in kept.collect()]
    assert texts.count(None) == 2 and len([t for t in texts if t]) == len(set(t for t in texts if t))
    assert near_dup.keep_one(empty(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    docs = corpus()
    kept = near_dup.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = {c for k, c in plain_classes(docs)}
    assert sorted(r.doc_id for r in kept) == sorted(want)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 80, dtype=np.uint64)
    errors = []
    for _ in range(6):
        a = rng.integers(0, 40, 80)
        b = np.where(rng.random(80) < 0.6, a, rng.integers(0, 40, 80))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = near_dup.signatures(doc, np.concatenate([h[a > 0], h[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.03


def test_signature_does_not_depend_on_the_batch():
    texts = [words(100, s) for s in range(5)] + ["a a a a a a a a a a a a a b"]
    def sign(ts):
        doc, h, _ = near_dup.shingles(ts)
        return near_dup.signatures(*near_dup.bags(doc, h), len(ts), 64)
    assert np.array_equal(sign(texts), np.concatenate([sign([t]) for t in texts]))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns, name
        after = out.count()
        assert 0.7 * before < after <= before
        assert out.select("doc_id").subtract(docs.select("doc_id")).count() == 0
        docs, before = out, after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF001)
    assert rows.where("piece = 0").count() == before


def test_pipeline_takes_awkward_rows(spark):
    for rows in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, rows, SF001).columns == rows.columns


def test_texts_of_a_component_meet_a_large_one_by_tiles(spark, monkeypatch):
    """40 texts are similar to all 59 members of a component but not to its pivot: a link of each is enough."""
    rng = np.random.default_rng(5)
    base = rng.integers(1, 2**63, 100, dtype=np.uint64)

    def text(node, root, swapped):
        h = base.copy()
        h[rng.choice(100, swapped, replace=False)] = rng.integers(1, 2**63, swapped, dtype=np.uint64)
        return node, root, 100, np.sort(h).tobytes(), np.ones(100, np.int32).tobytes()

    rows = [text(b"a", b"a", 20), *[text(b"m%02d" % i, b"a", 2) for i in range(59)],
            *[text(b"s%02d" % i, b"s%02d" % i, 3) for i in range(40)], text(b"z", b"z", 19)]
    bag = spark.createDataFrame([(n, s, h, c) for n, _, s, h, c in rows], "node binary, size bigint, hashes binary, counts binary")
    hot = spark.createDataFrame([(n, r) for n, r, *_ in rows], "node binary, root binary")
    for tile, tiles in ((1 << 16, 1), (2000, 3)):
        monkeypatch.setattr(near_dup, "TILE", tile)
        pairs = {(bytes(r.u), bytes(r.v)) for r in near_dup._filtered(hot, bag, 0.8).collect()}
        crossing = [(u, v) for u, v in pairs if u[:1] == b"m" or v[:1] == b"m"]
        assert {v for _, v in crossing if v[:1] == b"s"} == {b"s%02d" % i for i in range(40)}
        assert len(crossing) <= 41 * tiles


def test_components_grow_by_new_links_alone(spark):
    """The components so far and new links give those of all links together."""
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    links = lambda some: spark.createDataFrame(some, "u long, v long")
    roots = None
    for i in range(0, 90, 30):
        roots = near_dup._joined(roots, links(pairs[i:i + 30]))
        want = near_dup.connected_components(links(pairs[:i + 30]))
        assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, want.collect()))
