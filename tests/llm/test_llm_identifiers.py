"""Base spans against plain regular expressions; the bootstrap on a planted corpus."""

import random
import re

import pytest
from pyspark.sql import functions as F

from llm_data import awkward, awkward_rows, empty, words
from tokenmill import inputs
from tokenmill.llm import identifiers as I
from tokenmill.llm import queries

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "phone" and not 9 <= len(digits) <= 15
                    or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits))):
                continue
            out.append((kind, m.start(), m.end()))
    return out


def spans(df, column="spans"):
    return [(r.row["doc_id"], [tuple(s) for s in r[column]]) for r in df.select("row", column).collect()]


TEXTS = [
    None, "", " ", "a@b.c_d@e.f", "a@b.c@d.e.f", "x@y", "@a.b", "a@b..c", "a@-.-", "_%+-@a.b-c.d-", "a@b.c.", "ü@b.c ä a.b@ü.de",
    "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0255.00.000.1", "1.2.3", "1..2.3.4", "v1.2.3.4x", "1.2.3.4.256",
    "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111 1111 1111", "41111111111111110000",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8", "+1 (268) 555-9530", "+1 268", "+1234567890123456", "++49 30 123456", "+49 (0) 30. 12 34 56-", "+4",
    "\U0001F600 a@b.co \U0001F600\U0001F600 1.2.3.4", "日本 +49 30 1234567 語 4111111111111111", "a@b.c\x00d@e.f\n+1 234 567 890\n1.1.1.1",
    "9" * 5000, "1 " * 5000, "1." * 5000, "a@" * 3000, "a." * 3000 + "@x.y", "a@b" + ".c" * 4000, "+1" + "." * 5000 + "2", "(" * 2000 + "+1 2 3 4 5 6 7 8 9",
]


def test_base_spans_equal_plain_expressions(spark):
    rng = random.Random(5)
    noise = ["".join(rng.choice("ab1029.@+- ()_%ü\n") for _ in range(rng.randint(1, 60))) for _ in range(600)]
    texts = TEXTS + noise + [r[1] for r in awkward_rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: [tuple(s) for s in r.b] for r in df.select("doc_id", I.base_spans(F.col("text")).alias("b")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_base(text), (i, (text or "")[:80])


def test_long_runs_neither_recurse_nor_square(spark):
    texts = ["1 " * 300_000, "9" * 600_000, "1." * 300_000, "x" * 600_000 + "@", "a@b" + ".c" * 300_000, " 12345" * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.b for r in df.select("doc_id", F.transform(I.base_spans(F.col("text")), lambda s: s["kind"]).alias("b")).collect()}
    assert got[4] == ["email"] and got[3] == [] and len(got[2]) == 75_000
    seen = df.where("doc_id = 5").select(F.inline(I.candidates(F.col("text")))).count()
    assert seen == 0  # one run of digits, too long for an identifier


def planted():
    """Seeds behind telling words, and identifiers behind the same words that no base
    pattern knows; identifier-like tokens behind ordinary words."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        rows.append((f"please call +1 ({200 + i}) 555-{1000 + i} now", None))
        rows.append((f"server address: 10.0.{i}.{i + 1} is up", None))
    for i in range(5):
        rows.append((f"please call 030 {555000 + i} today", ("phone", f"030 {555000 + i}")))
        rows.append((f"server address: fe80::{i + 1}:a1:b2 is up", ("ip", f"fe80::{i + 1}:a1:b2")))
    for i in range(400):
        rows.append((f"{words(20, i)} the {rng.randint(10**6, 10**8)} {words(5, 1000 + i)}", None))
        rows.append((f"we all call {words(1, i)} and call {words(1, 7 * i)} a {words(1, 3 * i)}", None))
    rows.append(("first: 030 555002.", ("phone", "030 555002")))  # known by its value
    return rows


@pytest.fixture(scope="module")
def bootstrapped(spark):
    rows = [(i, t, None, "s", 1, 2, "t") for i, (t, _) in enumerate(planted())]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, seen string, start int, value int, t string")
    return dict(spans(I.extract(df.repartition(5), ["doc_id"])))


def test_contexts_find_identifiers_that_no_base_pattern_knows(bootstrapped):
    for i, (text, more) in enumerate(planted()):
        want = set(plain_base(text))
        if more:
            at = text.index(more[1])
            want.add((more[0], at, at + len(more[1])))
        assert set(bootstrapped[i]) == want, text


def test_copies_lend_no_support(spark):
    seeds = [(i, "ring +1 (268) 555-9530 or ring 030 555123") for i in range(50)]
    df = spark.createDataFrame(seeds, "doc_id long, text string")
    assert all(s == plain_base("ring +1 (268) 555-9530 or ring 030 555123") for _, s in spans(I.extract(df, ["doc_id"])))


def test_awkward_tables(spark):
    found = I.extract(awkward(spark), ["doc_id", "kept"])
    want = sorted(((r[0], plain_base(r[1])) for r in awkward_rows()), key=str)
    assert sorted(spans(found, "base"), key=str) == want == sorted(spans(found), key=str)
    nothing = I.extract(empty(spark), ["doc_id"])
    assert nothing.columns == ["row", "base", "spans"] and nothing.count() == 0


def test_redaction_keeps_columns_and_other_text(spark):
    df = spark.createDataFrame([(1, "me: a@b.co, ip 1.2.3.4!", "x"), (2, None, "y"), (3, "none", "z"), (3, "+1 234 567 8901 2345 6789", "w")],
                               "doc_id long, text string, all string")
    got = sorted(map(tuple, I.redact(df).collect()), key=str)
    assert got == sorted([(1, "me: [email], ip [ip]!", "x"), (2, None, "y"), (3, "none", "z"), (3, "+1 234 567 8901 2345 6789", "w")], key=str)


def test_query_over_whole_texts_runs_without_python(spark):
    import hashlib
    sf = "/root/testdata/sf0.01"
    df = queries.QUERIES["op13_identifiers"](spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    docs = {r.doc_id: r.text for r in inputs.table(spark, sf, "documents").collect()}
    rows = df.collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for k, _, _ in base) for kind in I.KINDS)
        assert {s for s in text.split(",")} <= {s for s in r.spans.split(",")}
