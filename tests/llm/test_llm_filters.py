import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_data import awkward, awkward_rows, empty, words
from pyspark.sql import functions as F

from tokenmill.llm import (decontaminate, language_id, lattice_lm, quality_classifier, quality_rules, redirects, sharding)
from tokenmill.llm import frames, subwords
from tokenmill.llm.components import connected_components


# ---- components and redirects -------------------------------------------------------------

def plain_roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent) if find(x) != x}


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2)],
    [(i, i + 1) for i in range(40)],                                  # a path
    [(0, i) for i in range(1, 50)] + [(100, 101), (101, 100)],        # a hub
    [((i * 7) % 60, (i * 13 + 5) % 60) for i in range(45)],
])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.node: r.root for r in connected_components(df).collect()} == plain_roots(edges)


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block")]


def test_url_rules(spark):
    urls = {"http://Example.COM/en/x?q": ("example.com", "/en/x", "example.com/en/", "block"),
            "http://a.www.example.com/en/#f": ("a.www.example.com", "/en/", "www.example.com/en/", "allow"),
            "https://example.com/de": ("example.com", "/de", "com/", "allow"),
            "https://example.com": ("example.com", "", None, "allow"),
            "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
            "http://x.net/es/1": ("x.net", "/es/1", "net/es/", "block"), "http://x.net/ES/1": ("x.net", "/ES/1", None, "allow"),
            "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "x://": ("", "", None, "allow"),
            "http:///p": ("", "/p", None, "allow"), "ftp://h.org?a/b": ("h.org", "", None, "allow")}
    pages = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(99, "http://x.net/es/1", "v")],
                                  "page_id long, url string, verdict string")
    got = redirects.judge(pages, redirects.rule_table(spark, RULES), spark.createDataFrame([], "u string, v string"),
                          ["page_id", "url", "verdict"]).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r.url


def test_blocks_pass_to_aliases_and_allow_stays(spark):
    link = "<html><link href='{}' rel=\"canonical\"></html>"
    pages = spark.createDataFrame([
        (1, "http://m.org/a", link.format("http://x.net/es/1")),              # alias of a blocked url that is no page
        (2, "http://n.org/b", "<LINK REL=canonical HREF=http://m.org/a>"),    # alias of an alias
        (3, "http://ok.com/c", link.format("http://x.net/es/1")),             # allowed by rule: stays
        (4, "http://p.org/d", link.format("http://ok.com/zzz")),              # alias of an allowed url
        (5, "http://q.org/e", '<meta http-equiv="refresh" content="0; url=http://n.org/b">'),
        (6, "http://r.org/f", link.format("/relative")),
        (7, None, link.format("http://x.net/es/1")),
        (8, "http://s.org/g", None)], "page_id long, url string, html string")
    got = redirects.judge(pages, redirects.rule_table(spark, RULES), redirects.canonical_links(pages), ["page_id"])
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "block",
                                                             6: "allow", 7: "allow", 8: "allow"}


def test_relative_and_quoted_targets_are_resolved(spark):
    link = "<link rel='canonical' href='{}'>"
    targets = {("http://a.net/x?q#f", "/es/1"): "http://a.net/es/1", ("https://a.org/x", "//b.net/es/1"): "https://b.net/es/1",
               ("http://c.net/es/a", "b?c"): "http://c.net/es/b?c", ("http://c.net", "es/1"): "http://c.net/es/1",
               ("http://c.net/a?b#c", "?d"): "http://c.net/a?d", ("http://c.net/a?b#c", "#d"): "http://c.net/a?b#d",
               ("http://c.net/a", "mailto:x"): None, ("no url", "/es/1"): None, ("no url", "http://d.net/e"): "http://d.net/e",
               ("http://c.net/a/b/c", "../d/./e/..?f/../g"): "http://c.net/a/d/?f/../g", ("http://c.net/a", "../../b"): "http://c.net/b",
               ("http://e.org/a", "b?u=http://x.net/es/1"): "http://e.org/b?u=http://x.net/es/1"}
    pages = spark.createDataFrame([(u, link.format(v)) for u, v in targets], "url string, html string")
    assert {(r.u, r.v) for r in redirects.canonical_links(pages).collect()} == {(u, v) for (u, _), v in targets.items() if v}
    quoted = """<meta http-equiv="refresh" content="0; url='{}'">"""
    pages = spark.createDataFrame([
        (1, "http://x.net/x", link.format("/es/1")), (2, "http://m.org/a", link.format("//x.net/es/1")),
        (3, "http://q.org/d", "<base href='http://y.net/es/a'>" + quoted.format("b")), (4, "http://n.org/b", quoted.format("http://x.net/es/2")),
        (5, "http://p.org/c", link.format("/es/1"))], "page_id long, url string, html string")
    got = redirects.judge(pages, redirects.rule_table(spark, RULES), redirects.canonical_links(pages), ["page_id"])
    assert {r.page_id: r.verdict for r in got.collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}


def test_entities_and_host_case_join_links(spark):
    link = '<link rel="canonical" href="{}">'
    pages = spark.createDataFrame([
        (1, "http://m.org/a?x=1&y=2", ""), (2, "http://n.org/b", link.format("HTTP://M.org/a?x=1&amp;y=2")),
        (3, "HTTP://M.ORG/a?x=1&y=2", link.format("http://x.net/es/1")), (4, "http://m.org/A?x=1&y=2", ""),
        (5, "http://o.org/c", link.format("http://n.org/b")), (5, "http://o.org/c", link.format("http://n.org/b"))],
        "page_id long, url string, html string")
    got = redirects.judge(pages, redirects.rule_table(spark, RULES), redirects.canonical_links(pages), ["page_id"])
    assert sorted((r.page_id, r.verdict) for r in got.collect()) == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "block"), (5, "block")]


def plain_verdicts(pages, rules):
    """Rules and alias components by hand, over pages (id, url, targets)."""
    def parts(url):
        at = (url or "").find("://")
        rest = re.match(r"[^?#]*", url[at + 3:])[0] if at >= 0 else ""
        host = rest.split("/")[0]
        return host.lower(), rest[len(host):]

    def key(url):
        at = (url or "").find("://")
        if at < 0:
            return url
        host = re.match(r"[^/?#]*", url[at + 3:])[0]
        return url[:at].lower() + "://" + host.lower() + url[at + 3 + len(host):]

    def rule(url):
        host, path = parts(url)
        fits = [(r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
                and path.startswith(r[r.index("/"):]) and host]
        return max(fits, key=lambda x: len(x[0]), default=(None, None))

    links = defaultdict(set)
    for _, url, targets in pages:
        for t in targets:
            links[key(url)].add(key(t)), links[key(t)].add(key(url))

    def blocked(node):
        seen, todo = {node}, [node]
        while todo:
            for m in links[todo.pop()] - seen:
                seen.add(m), todo.append(m)
        return any(rule(u)[1] == "block" for u in seen)

    return sorted((i, *parts(u), rule(u)[0], rule(u)[1] or ("block" if u and key(u) in links and blocked(key(u)) else "allow"))
                  for i, u, _ in pages)


def linked_pages(n=120, seed=4):
    rng = random.Random(seed)
    hosts = ["a.com", "www.example.com", "example.com", "x.net", "n.org", "Q.org", "r.org:80", "www.b.net"]
    paths = ["/", "/es/1", "/en/x", "/fr/y?q=1&r=2", "/z/w", "", "/en/"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{'' if rng.random() < 0.5 else rng.randint(0, 9)}" for _ in range(n)]
    return [(i, u, [rng.choice(urls)] if rng.random() < 0.4 else []) for i, u in enumerate(urls)]


def linked_frame(spark, pages):
    html = [(i, u, "".join(f'<head><link rel="canonical" href="{t.replace("&", "&amp;")}"></head>' for t in ts)) for i, u, ts in pages]
    return spark.createDataFrame(html + [(999, None, "")], "page_id long, url string, html string")


def test_verdicts_over_linked_pages_equal_brute_force_and_the_sql(spark):
    import duckdb
    from tokenmill.llm import queries
    pages = linked_pages()
    frame = linked_frame(spark, pages)
    got = redirects.judge(frame, redirects.rule_table(spark, queries.RULES), redirects.canonical_links(frame), ["page_id"])
    rows = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect())
    want = plain_verdicts(pages, queries.RULES) + [(999, "", "", None, "allow")]
    assert [r for r in rows] == sorted(want)
    assert sum(r[3] is None and r[4] == "block" for r in rows) > 3  # decided by aliases
    con = duckdb.connect()
    con.register("pages", frame.toPandas())
    sql = con.sql(queries.ORACLE["op1_redirect_filter"]).df().astype(object)
    sql = sql.where(sql.notna(), None)
    assert sorted(map(tuple, sql[["page_id", "host", "path", "rule", "verdict"]].values.tolist())) == rows


def test_judging_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert redirects.judge(none, redirects.rule_table(spark, RULES), redirects.canonical_links(none), ["page_id"]).count() == 0


NAMES = ["features", "votes", "posterior", "quality", "quality_score", "contamination", "best", "key_hash", "told", "row", "of", "label", "mark",
         "__f", "__votes", "__p", "__quality", "__quality_score", "__best", "__h", "__contamination", "__key", "__label"]


def test_columns_of_any_name_pass_through(spark):
    rows = [(i, words(90, i), *range(len(NAMES))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in NAMES))
    bench = spark.createDataFrame([("t", words(90, 3))], "item_id string, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    for got, n in ((quality_rules.keep_good(docs), 12), (quality_classifier.keep_good(docs, labels), 12),
                   (decontaminate.drop_documents(docs, bench), 11), (decontaminate.remove_spans(docs, bench), 12)):
        assert got.columns == docs.columns and got.count() == n
        assert all(tuple(r)[2:] == tuple(range(len(NAMES))) for r in got.collect())
    placed = sharding.shard_rows(docs, "doc_id", [1.0] * 3)
    assert placed.columns == [*docs.columns, "shard", "grown_shard", "slot"] or set(docs.columns) < set(placed.columns)
    assert all(tuple(r[n] for n in NAMES) == tuple(range(len(NAMES))) for r in placed.collect())


# ---- quality rules ------------------------------------------------------------------------

def test_rule_features_equal_a_plain_count():
    import re
    for _, text, *_ in awkward_rows() + [(0, "a b c a b c d\na\na\n \nx", None)]:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(zip(ws, ws[1:], ws[2:]))
        inside = {j for i in range(len(ws) - 2) if seen[tuple(ws[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        got = dict(zip(quality_rules.FEATURES, quality_rules.features_of(text)))
        assert (got["n_words"], got["word_chars"]) == (len(ws), sum(map(len, ws)))
        assert got["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>")
        assert got["n_dup_lines"] == sum(x in lines[:i] for i, x in enumerate(lines))
        assert got["n_repeat_words"] == len(inside)


def test_em_finds_the_rules_that_are_right():
    rng = np.random.default_rng(5)
    rules = [quality_rules.Rule(f"f{i}", "bad", "") for i in range(3)] + [quality_rules.Rule("g", "good", "")]
    truth = rng.random(20_000) < 0.8
    fires = np.array([[0.02, 0.5], [0.01, 0.4], [0.1, 0.1]])  # the third says nothing
    cast = [np.where(rng.random(len(truth)) < np.where(truth, a, b), "b", "-") for a, b in fires]
    cast.append(np.where(rng.random(len(truth)) < np.where(truth, 0.9, 0.2), "g", "-"))
    patterns = ["".join(x) for x in zip(*cast)]
    counts = Counter(patterns)
    names = sorted(counts)
    model = quality_rules.fit_votes(names, [counts[p] for p in names], rules)
    assert abs(model.good - 0.8) < 0.05
    assert abs(model.cast[1, 0, 1] - 0.5) < 0.06 and abs(model.cast[0, 3, 0] - 0.9) < 0.03
    chance = dict(zip(names, model.posterior(names)))
    assert np.mean([(chance[p] >= 0.5) == t for p, t in zip(patterns, truth)]) > 0.9


def test_rules_keep_clean_and_drop_junk(spark):
    rows = [(i, words(100, i)) for i in range(60)]
    rows += [(100 + i, " ".join(w + "###" for w in words(100, i).split())) for i in range(8)]
    rows += [(200 + i, (words(6, i) + "\n") * 30) for i in range(8)] + [(300, "too short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in quality_rules.keep_good(docs).collect()}
    assert kept == set(range(60))


def test_rules_take_awkward_rows(spark):
    judged = quality_rules.judge(awkward(spark), ["doc_id", "kept"]).collect()
    assert len(judged) == len(awkward_rows())
    assert all(r.quality.base_failed and not r.quality.kept for r in judged if r.quality.n_words < 50)
    assert quality_rules.judge(empty(spark), ["doc_id"]).count() == 0
    assert quality_rules.keep_good(awkward(spark)).columns == awkward(spark).columns


# ---- language ---------------------------------------------------------------------------

def test_language_filter(spark):
    pools = {"aa": "abcdef", "bb": "efghij", "cc": "klmnop"}
    rng = np.random.default_rng(2)
    def text(lang, n):
        return " ".join("".join(rng.choice(list(pools[lang]), rng.integers(2, 8))) for _ in range(n))
    rows = [(i, text(l, 80), l) for l in pools for i in range(40)] + [(0, None, "aa"), (0, "abc", None)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(pools)
    fresh = [(text(l, 12), l) for l in pools for _ in range(30)]
    names, scores = model.judge([t for t, _ in fresh])
    assert np.mean([n == l for n, (_, l) in zip(names, fresh)]) > 0.97 and ((scores >= 0) & (scores <= 1)).all()
    names, scores = model.judge([None, "", "123 !!", "日本", "a"])
    assert names[:3] == ["und"] * 3 and names[3] in pools and scores[:3].tolist() == [0, 0, 0]


def test_a_hundred_languages(spark):
    """As many as there are, in several words a position; each text in its own alphabet."""
    def text(k, n, seed):
        rng = random.Random(1000 * k + seed)
        return " ".join("".join(chr(0x4E00 + 40 * k + rng.randint(0, 15)) for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(k, text(k, 60, i), f"l{k:03d}") for k in range(100) for i in range(3)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == [f"l{k:03d}" for k in range(100)] and model.masks.shape[1] == 2
    names, _ = model.judge([text(k, 40, 99) for k in range(100)])
    assert names == model.languages


def test_language_counts_equal_a_plain_filter(spark):
    """The registered prediction against exact sets of n-grams in place of the filter."""
    from tokenmill.llm import queries
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    counts = defaultdict(Counter)
    for d in docs:
        if not held(d.doc_id) and d.lang is not None and d.text is not None:
            counts[d.lang].update(language_id.ngrams([d.text])[1].tolist())
    known = {x: {g for g, n in c.items() if n >= language_id.MIN_SHARE * sum(c.values())} for x, c in counts.items()}
    got = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, sf).collect()}
    right = 0
    for d in docs:
        r = got[d.doc_id]
        _, grams, has = language_id.ngrams([d.text])
        assert r.held_out == held(d.doc_id) and 0 <= r.score <= 1 and (r.lang_pred == "und") == (not has[0])
        if has[0]:
            hits = {x: sum(g in own for g in grams.tolist()) for x, own in known.items()}
            right += hits[r.lang_pred] == max(hits.values())
    assert right >= 0.99 * sum(r.lang_pred != "und" for r in got.values())


def test_bloom_filter_has_no_false_negatives_and_corrects_chance():
    rng = np.random.default_rng(9)
    grams = rng.integers(1, 2**63, 5000, dtype=np.uint64)
    owned = (np.uint64(1) << rng.integers(0, 3, 5000, dtype=np.uint64))[:, None]
    f = language_id.LanguageFilter.build(["a", "b", "c"], grams, owned, 0)
    assert ((f.contains(grams) & owned) == owned).all()
    strange = f.contains(rng.integers(1, 2**63, 200_000, dtype=np.uint64))
    for i in range(3):
        rate = f._bit(strange, i).mean()
        assert abs(rate - f.chance[i]) < 0.3 * f.chance[i] + 1e-4


def test_language_takes_awkward_rows(spark):
    model = language_id.learn(awkward(spark))
    got = language_id.identify(awkward(spark), model, ["doc_id", "lang_pred", "score"][:1]).collect()
    assert len(got) == len(awkward_rows())
    nothing = language_id.learn(empty(spark))
    assert {r.lang_pred for r in language_id.identify(awkward(spark), nothing, ["doc_id"]).collect()} == {"und"}
    assert language_id.identify(empty(spark), model, ["doc_id"]).count() == 0


def test_language_counts_take_one_pass_over_the_texts(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    rows = spark.createDataFrame([(i, f"wor{i} dabc", "ab"[i % 2]) for i in range(50)], "doc_id long, text string, lang string")
    language_id.learn(rows.withColumn("text", seen.asNondeterministic()("text")))
    assert read.value == 50


def test_counted_ngrams_equal_the_ngrams_one_by_one():
    """With small and large alphabets, whose n-grams have tables, numbers or only hashes."""
    rng = random.Random(5)
    wide = "".join(chr(rng.randrange(0x3400, 0x9fff)) for _ in range(3000))
    for texts in ([None], [""], ["a", "", "12 b\n", "\ud800x"], ["ab ba abba"] * 3, [wide, "ab", wide[:9]],
                  ["".join(chr(c) for c in range(0x110000) if chr(c).isalpha())]):
        gram, n = language_id.counted(texts)
        want = Counter(language_id.ngrams(texts)[1].tolist())
        assert Counter(dict(zip(gram.tolist(), n.tolist()))) == want and len(gram) == len(want)


@pytest.mark.parametrize("languages", [3, 9, 20, 40, 70])
def test_judged_hits_equal_those_of_each_ngram(languages):
    rng = random.Random(languages)
    texts = [None, "", "7", "a", "ab\ncd"] + ["".join(rng.choice("abcde éßЖ日1 ") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    grams = np.unique(language_id.ngrams(texts)[1])[::2]
    owned = np.zeros((len(grams), -(-languages // 64)), np.uint64)
    for i in range(len(grams)):
        k = rng.randrange(languages)
        owned[i, k // 64] = np.uint64(1) << np.uint64(k % 64)
    f = language_id.LanguageFilter.build([f"l{k:02d}" for k in range(languages)], grams, owned, 0)
    names, scores = f.judge(texts)
    for text, name, score in zip(texts, names, scores):
        _, own, has = language_id.ngrams([text])
        found = f.contains(own)
        hits = np.array([f._bit(found, k).sum() for k in range(languages)])
        true = np.maximum((hits - len(own) * f.chance) / (1 - f.chance), 0)
        want = f.languages[int(true.argmax())] if true.sum() > 0 else f.languages[0]
        assert name == (want if has[0] else "und")
        assert score == pytest.approx(true.max() / true.sum() if has[0] and true.sum() > 0 else 0)


# ---- decontamination ---------------------------------------------------------------------

def plain_hits(text, items, window):
    ws = decontaminate.words_of(text)
    hit, owners = set(), set()
    for item, t in items:
        own = decontaminate.words_of(t)
        k = min(window, len(own))
        if item is None or not k:
            continue
        wins = {tuple(own[i:i + k]) for i in range(len(own) - k + 1)}
        for i in range(len(ws) - k + 1):
            if tuple(ws[i:i + k]) in wins:
                hit |= set(range(i, i + k))
                owners.add(str(item))
    return len(ws), len(hit), sorted(owners)


@pytest.mark.parametrize("block_pairs", [20, 100_000])
def test_decontamination_equals_brute_force(spark, block_pairs):
    items = [(1, words(30, 50)), (2, words(4, 51)), (3, ""), (4, None), (None, words(12, 52)), (5, words(30, 50)), (1, words(15, 53)),
             (10, "ONE, two! Three")]
    docs = [(i, words(40, i) + " " + words(30, 50)[:5 + 12 * i] + "\n" + words(10, i + 9)) for i in range(8)]
    docs += [(20, words(4, 51).upper().replace(" ", " -- ")), (21, words(12, 52)), (22, None), (23, ""),
             (24, "one two\nTHREE four one two three"), (25, words(30, 50) + " " + words(15, 53)), (25, words(3, 1))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"), bench, ["doc_id", "text"],
                             block_pairs=block_pairs, clean=True).collect()
    assert len(got) == len(docs)
    for r in got:
        c = r.contamination
        assert (c.n_words, c.n_hit, sorted(c.item_ids)) == plain_hits(r.text, items, 10)
        assert sum(x["last"] - x["first"] + 1 for x in c.ranges) == c.n_hit
        left = decontaminate.words_of(c.clean_text)
        ws = decontaminate.words_of(r.text)
        cut = {j for x in c.ranges for j in range(x["first"], x["last"] + 1)}
        assert left == [w for j, w in enumerate(ws) if j not in cut]


def test_windows_shared_by_many_items_and_long_items(spark):
    text = words(40, 8)
    bench = spark.createDataFrame([(f"i{k}", text) for k in range(50)] + [("long", words(5000, 9)), (None, text), ("none", None), ("w", "  ")],
                                  "item_id string, text string")
    docs = spark.createDataFrame([(1, words(5, 1) + " " + text), (2, words(60, 2)), (3, " ".join(words(5000, 9).split()[100:112]))],
                                 "doc_id long, text string")
    got = {r.doc_id: r.contamination for r in decontaminate.scan(docs, bench, ["doc_id"], block_pairs=700).collect()}
    assert sorted(got[1].item_ids) == sorted(f"i{k}" for k in range(50)) and got[1].n_hit == 40
    assert got[2].n_hit == 0 and (got[3].item_ids, got[3].n_hit) == (["long"], 12)
    assert decontaminate.windows_of(bench).count() == 50 * 31 + 4991
    assert decontaminate.scan(docs, bench.limit(0), ["doc_id"]).where("contamination.n_hit > 0").count() == 0


def test_decontamination_takes_awkward_rows(spark):
    docs = awkward(spark)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert {r.doc_id for r in docs.subtract(decontaminate.drop_documents(docs, bench)).collect()} == {9}
    assert decontaminate.remove_spans(docs, bench).where("doc_id = 9").first().text.strip() == ""
    assert decontaminate.drop_documents(docs, bench.limit(0)).count() == len(awkward_rows())
    assert decontaminate.drop_documents(empty(spark), bench).count() == 0


# ---- classifier --------------------------------------------------------------------------

def test_batches_of_workers_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("abcdefghi "), 10_000).alias("text"))  # 40 MB
    found = frames.map_batches(rows, ["text"], "n bigint, bytes bigint", sizes).collect()
    assert sum(r["n"] for r in found) == 400
    assert max(r["bytes"] for r in found) < frames.BATCH_BYTES + 200_000


def test_batches_of_a_session_that_sets_them_are_left(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    frames.map_batches(other.range(3), ["id"], "id bigint", lambda batches: batches).collect()
    assert other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"


def test_chunks_are_bounded_in_bytes_and_rows():
    batch = pa.record_batch([pa.array(["a" * 10] * 7 + [None, "b" * 100])], ["text"])
    assert [c.num_rows for c in frames.text_chunks(batch, "text", 40)] == [4, 4, 1]
    assert [c.num_rows for c in frames.text_chunks(batch, "text", 40, 3)] == [3, 3, 2, 1]


def test_features_of_words_come_in_blocks(monkeypatch):
    texts = pa.array([" ".join(f"w{i}é" for i in range(500)), None, "x" * 3000])
    whole = subwords.WordBatch(texts).features(1 << 16)
    monkeypatch.setattr(subwords, "LETTERS", 100)
    blocks = list(subwords.WordBatch(texts).feature_blocks(1 << 16))
    assert len(blocks) > 30 and [a for a, *_ in blocks[1:]] == [b for _, b, *_ in blocks[:-1]]
    pairs = [(w + a, f) for a, _, word, feature in blocks for w, f in zip(word.tolist(), feature.tolist())]
    at = {}
    for w, f in pairs:
        at.setdefault(w, []).append(f)
    plain = {}
    for w, f in zip(whole[0].tolist(), whole[1].tolist()):
        plain.setdefault(w, []).append(f)
    assert at == plain  # in each word's order, so that sums are the same to the last bit


def test_classifier_learns_and_repeats(spark):
    rng = np.random.default_rng(4)
    def make(i):
        good = i % 4 > 0
        return i, words(60, i) if good else " ".join(w + "$$" for w in words(60, i).split()), int(good)
    rows = spark.createDataFrame([make(i) for i in range(240)], "doc_id long, text string, label int")
    train, rest = rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")
    model = quality_classifier.fit(train)
    again = quality_classifier.fit(train.repartition(7))
    assert np.array_equal(model.vectors, again.vectors)  # whatever the partitions
    got = quality_classifier.score(rest, model, ["doc_id", "label"]).collect()
    assert np.mean([(r.quality_score >= 0.3) == (r.label == 1) for r in got]) > 0.95
    few = quality_classifier.fit(train, max_rows=50)
    assert few.vectors.shape == model.vectors.shape


def test_scores_equal_a_plain_average_of_vectors(spark):
    """The registered scores against vectors averaged text by text with a softmax layer."""
    from tokenmill.llm import queries
    from tokenmill.llm.subwords import EXTRA, WordBatch
    import pyarrow as pa
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality_classifier.held_out(F.col("doc_id"), 5, 0))
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = quality_classifier.fit(docs.select("doc_id", "text").join(labels, "doc_id"))
    got = {r.doc_id: r for r in queries.QUERIES["op8_quality_classifier"](spark, sf).collect()}
    n = len(model.vectors) - EXTRA
    for d in docs.orderBy("doc_id").limit(60).collect():
        words_ = WordBatch(pa.array([d.text], pa.string()))
        owner, bucket = words_.features(n)
        used = np.concatenate([bucket[owner == w] for w in words_.word]) if len(words_.word) else np.zeros(0, int)
        repeats = words_.repeats()[0] * quality_classifier.REPEAT_WEIGHT
        total = model.vectors[used].sum(0) + repeats @ model.vectors[n:]
        size = len(used) + repeats.sum()
        out = (total / size if size else total) @ model.layer + model.bias
        want = np.exp(out[1] - out.max()) / np.exp(out - out.max()).sum()
        r = got[d.doc_id]
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


def test_training_rows_are_bounded_in_rows_and_features(spark):
    rows = [(1, words(30, 1), 1)] * 400 + [(i, words(30, i), i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    seen = []
    plain = quality_classifier.train
    quality_classifier.train = lambda examples, *a, **k: seen.append(examples) or plain(examples, *a, **k)
    try:
        quality_classifier.fit(df, epochs=1)
        quality_classifier.fit(df, max_rows=100, epochs=1)
        quality_classifier.fit(df, max_entries=3000, epochs=1)
    finally:
        quality_classifier.train = plain
    assert len(seen[0]) == 300  # the row repeated 401 times counts once
    assert 10 < len(seen[1]) < 100 and sum(len(i) for i, _, _ in seen[2]) <= 3000 and len(seen[2]) > 3


def test_classifier_takes_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (8, 1), (None, 1), (3, None)], "doc_id long, quality int")
    kept = quality_classifier.keep_good(awkward(spark), labels, threshold=0.0)
    assert kept.columns == awkward(spark).columns and kept.count() == len(awkward_rows())
    model = quality_classifier.fit(empty(spark).withColumn("label", F.lit(1)))
    got = quality_classifier.score(awkward(spark), model, ["doc_id", "score"], out="score").collect()
    assert {round(r.score, 6) for r in got} == {0.5}
    assert quality_classifier.score(empty(spark), model, ["doc_id"]).count() == 0


def test_held_out_is_crc32_of_the_key(spark):
    df = spark.range(50).select(quality_classifier.held_out(F.col("id"), 5, 0).alias("h"), "id")
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in df.collect())


# ---- lattice ---------------------------------------------------------------------------

def every_segmentation(lattice, word):
    word = lattice_lm.MARK + word
    total = {0: 0.0}

    def walk(at):
        if at == len(word):
            return [0.0]
        out = []
        plain = False
        for end in range(at + 1, len(word) + 1):
            p = lattice.spelled.get(word[at:end])
            if p is not None:
                plain |= end == at + 1
                out += [lattice.logp[p] + x for x in walk(end)]
        if not plain:
            cost = lattice.logp[lattice._spelling(ord(word[at]))].sum()
            out += [cost + x for x in walk(at + 1)]
        return out
    return np.logaddexp.reduce(walk(0)) + total[0]


def test_marginal_is_the_sum_over_all_segmentations():
    pieces = lattice_lm.load_pieces(lattice_lm.tokenizer_path(lattice_lm.VOCABULARY))
    lattice = lattice_lm.Lattice(pieces, lattice_lm.initial(pieces))
    some = ["the", "there", "thing,", "über", "日", "a", "", "\U0001F600"]
    got, uses = lattice.marginal(some, np.ones(len(some)))
    assert np.allclose(got, [every_segmentation(lattice, w) for w in some])
    long = ["therewith" * 8, "x" * 300]
    one, use_one = lattice.marginal(long, np.ones(2))
    old, lattice_lm.TOGETHER = lattice_lm.TOGETHER, 10_000
    try:
        two, use_two = lattice.marginal(long, np.ones(2))
    finally:
        lattice_lm.TOGETHER = old
    assert np.allclose(one, two) and np.allclose(use_one, use_two)
    # expected uses are the derivative of the score by the piece's log-probability
    i = lattice.spelled["the"]
    up = lattice.logp.copy()
    up[i] += 1e-6
    shift = lattice_lm.Lattice(pieces, up).marginal(some)[0].sum() - got.sum()
    assert abs(shift / 1e-6 - uses[i]) < 1e-3


def test_em_raises_the_likelihood():
    pieces = lattice_lm.load_pieces(lattice_lm.tokenizer_path(lattice_lm.VOCABULARY))
    logp, some = lattice_lm.initial(pieces), words(300, 6).split()
    before = -np.inf
    for _ in range(3):
        now, uses = lattice_lm.Lattice(pieces, logp).marginal(some, np.ones(len(some)))
        assert now.sum() > before
        before = now.sum()
        logp = np.log((uses + 1e-9) / (uses + 1e-9).sum())


@pytest.mark.parametrize("common", [1e-6, 1.0])
def test_lattice_scores_awkward_rows(spark, common):
    docs = awkward(spark)
    got = lattice_lm.score(docs, F.col("doc_id") != 9, common=common).collect()
    assert len(got) == len(awkward_rows())
    train = [r[1] for r in awkward_rows() if r[0] is not None and r[0] != 9]
    split = lambda t: (t or "").encode().lower().split()
    c = Counter(w for t in train for w in split(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    want = sorted((len(split(r[1])) + 1, sum(c[w] > 0 for w in split(r[1])) + 1, n,
                   round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in split(r[1])) + np.log10((len(train) + 1) / (n + v + 1)), 6))
                  for r in awkward_rows())
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert len({round(r.score, 9) for r in got if r.n_tokens == 1}) == 1  # null, empty and blank: only the end
    assert lattice_lm.score(empty(spark), F.lit(True)).count() == 0


# ---- sharding ---------------------------------------------------------------------------

def test_shards_are_stable_and_weighted(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    weights = [1.0, 1.0, 2.0]
    rows = sharding.shard_rows(df, "doc_id", weights).collect()
    share = Counter(r.shard for r in rows)
    assert all(abs(share[i] / 4000 - w / 4) < 0.03 for i, w in enumerate(weights))
    for s in share:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(share[s]))
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    more = {r.doc_id: r.shard for r in sharding.shard_rows(df, "doc_id", [*weights, 2.0]).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in rows)
    assert 0.2 < sum(r.grown_shard == 3 for r in rows) / 4000 < 0.47


def test_sharding_takes_awkward_rows(spark):
    rows = sharding.shard_rows(awkward(spark), "doc_id", [1.0] * 3).collect()
    assert len(rows) == len(awkward_rows())
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1 and len({r.shard for r in rows if r.doc_id is None}) == 1
    for s in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shard_rows(empty(spark), "doc_id", [1.0] * 3).count() == 0


def test_examples_are_packed_on_their_way_to_the_driver():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3000):
        ids = np.sort(rng.choice(1 << 16, n, replace=False)).astype(np.int32)
        shares = (rng.choice([1, 1, 1, 1, 2, 3], n) / max(1, n)).astype(np.float32)
        packed = quality_classifier._packed(ids, shares)
        got = quality_classifier._unpacked(packed)
        assert got[0].dtype == np.int32 and got[1].dtype == np.float32
        assert got[0].tolist() == ids.tolist() and got[1].tolist() == shares.tolist()
    assert len(packed) < 8 * n / 3
