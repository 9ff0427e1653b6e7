"""Personal identifiers by bootstrapped contextual extraction, in column functions only.

Base spans are those of fixed patterns per kind (email, ip, card, phone) with their
checks. They are the seeds of a bootstrap that finds identifiers the patterns miss:

1. Candidates are words with a digit or an ``@``, and runs of digits with separators.
   Each meets two lexical patterns: the word before it, and the two words before it
   (lower case; an earlier candidate counts as one fixed word). A candidate that holds
   a base span is a seed of that kind.
2. A pattern may count if it precedes at least ``SUPPORT`` different candidates. Its size
   is the number of different words and candidates that it precedes anywhere in the
   corpus, so ``the`` is a poor pattern however many identifiers follow it.
3. Patterns and candidates are a graph, scored in ``ROUNDS`` rounds: a pattern's
   confidence in a kind is the share of its size whose candidates are known to be of
   that kind (one is added to the size, and less than ``SUPPORT`` known ones count
   nothing); a candidate whose shape suits the kind has the noisy-or of its patterns'
   confidences, and is known from a score of ``SURE`` on. What a round finds makes new
   patterns reliable in the next.
4. Every occurrence of a candidate so found, where no base span lies, is a span more.

Different candidates are counted, not their occurrences, so copies of a document lend
no weight. The graph holds only candidates behind patterns of some support; nothing of
it is collected. Positions are code points; they are summed from the gaps between
matches, in blocks, so a text with many matches costs about linear time.

A null or empty text has no spans. Equal texts have equal results, and every row has
its own. An empty table gives no rows. Candidates of more than ``LONGEST`` characters are
no identifiers. Columns of the caller come back in the struct ``row``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.frames import stored

KINDS = ("email", "ip", "card", "phone")
# The base patterns, written so that no run of characters is read more than once and no
# repetition recurses: a match starts where a run of its characters starts (or where the
# last match ended), and repetitions don't give back what they have taken.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CANDIDATE = r"(?<!\S)(?:[+(]?[0-9](?:[ ().\-/]{0,2}+[0-9])++(?![A-Za-z0-9@_])|[^\s0-9@]*+[0-9@]\S*+)"
# What a text with a match has to hold; quicker to look for than the match.
HINTS = {PATTERNS["email"]: "@", PATTERNS["ip"]: r"[0-9]\.[0-9]", PATTERNS["phone"]: r"\+[0-9]", CANDIDATE: "[0-9@]"}
# What a found candidate of each kind has to look like.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,7}$",
    "card": r"^[0-9](?:[ .-]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[ ().\-/]{0,2}[0-9]){6,14}$",
}
SUPPORT, TRUST, SURE, ROUNDS = 3, 0.5, 0.8, 3
# Stands for a candidate among the words.
MARK = "\x01"
LONGEST = 64
# Relative standard error of the sketch that counts a pattern's followers.
ERROR = 0.1
# Characters before a candidate in which its two words are looked for.
REACH = 96
BLOCK = 64


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return total + F.when((n - i) % 2 == 1, doubled[d]).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _ends(lengths: Column) -> Column:
    """The sum of the elements up to and with each, of an array of numbers."""
    def of_blocks(blocks: Column) -> Column:
        return _let(F.transform(blocks, _total), lambda sums: F.flatten(F.transform(blocks, lambda part, b: _let(
            _total(F.slice(sums, 1, b)), lambda ahead: F.transform(part, lambda x, i: ahead + _total(F.slice(part, 1, i + 1)))))))

    last = F.call_function("div", F.size(lengths) - 1, F.lit(BLOCK)).cast("int")
    return _let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK)), of_blocks)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value, gap>>`` of a pattern's matches, leftmost and not
    overlapping; ``gap`` is the text between the match before and this one."""
    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("values"), F.split(text, pattern, -1).alias("gaps"))

    def placed(p: Column) -> Column:
        pairs = F.zip_with(p["values"], F.slice(p["gaps"], 1, F.size(p["values"])), lambda v, g: F.struct(
            v.alias("value"), g.alias("gap"), (F.length(v) + F.length(g)).cast("bigint").alias("n")))
        return _let(pairs, lambda q: F.zip_with(q, _ends(F.transform(q, lambda m: m["n"])), lambda m, end: F.struct(
            (end - F.length(m["value"])).alias("start"), end.alias("end"), m["value"].alias("value"), m["gap"].alias("gap"))))

    # most texts have no match, and then nothing above is worked out
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,gap:string>>")
    return F.when(text.rlike(HINTS.get(pattern, pattern)), _let(pieces, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """``array<struct<kind, start, end>>`` by kind as listed, then start."""
    text = F.coalesce(text, F.lit(""))

    def of_kind(kind: str) -> Column:
        counting = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["value"]))
        return F.transform(counting, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*[of_kind(k) for k in KINDS])


def seed_kind(value: Column) -> Column:
    """The kind of the base span that a candidate holds (null: none)."""
    kind = F.lit(None).cast("string")
    for k in ("card", "phone", "ip", "email"):
        inner = F.regexp_extract(value, PATTERNS[k], 0)
        kind = F.when((inner != "") & valid(k, inner), F.lit(k)).otherwise(kind)
    return kind


def _words_before(gap: Column, first: Column) -> Column:
    """The last words of a gap, at most two, lower case."""
    near = F.lower(F.substring(F.when(first, gap).otherwise(F.concat(F.lit(MARK), gap)), -REACH, REACH))
    words = F.filter(F.split(near, r"\s+"), lambda w: w != "")
    return _let(words, lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)))


def candidates(text: Column) -> Column:
    """``array<struct<start, end, value, seed, words>>``; the ``value`` is without the
    marks around it, ``words`` are the (at most two) before it."""
    text = F.coalesce(text, F.lit(""))

    def one(m: Column, i: Column) -> Column:
        value = F.regexp_replace(m["value"], r"^[^A-Za-z0-9+(]*+|[^A-Za-z0-9)]++$", "")
        start = m["start"] + F.length(F.regexp_extract(m["value"], r"^[^A-Za-z0-9+(]*+", 0))
        return _let(F.struct(start.alias("start"), value.alias("value")), lambda c: F.struct(
            c["start"].alias("start"), (c["start"] + F.length(c["value"])).alias("end"), c["value"].alias("value"),
            seed_kind(c["value"]).alias("seed"), _words_before(m["gap"], i == 0).alias("words")))

    return F.filter(F.transform(matches(text, CANDIDATE), one), lambda c: F.length(c["value"]).between(2, LONGEST))


def _patterns(words: Column) -> Column:
    """The lexical patterns of the words before a place."""
    two = F.when(F.size(words) == 2, F.array_join(words, " "))
    return F.filter(F.array(F.when(F.size(words) > 0, F.element_at(words, -1)), two), lambda p: p.isNotNull())


def sightings(found: DataFrame) -> DataFrame:
    """``(pattern, value, seed)``: the different candidates behind every pattern of support.
    ``found``: a row per occurrence, with the columns of ``candidates``."""
    seen = found.where(F.size("words") > 0).select(F.explode(_patterns(F.col("words"))).alias("pattern"), "value", "seed")
    seen = seen.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    support = seen.groupBy("pattern").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") >= SUPPORT)
    return seen.join(support, "pattern")


def plain_followers(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, plain)``: how many different words other than candidates follow each of
    the ``patterns``, over all texts (column ``text``). Counted by a sketch of fixed size
    per pattern, which is near exact for small numbers and ``ERROR`` off for large ones,
    so a task sends on one row per pattern and not one per word."""
    low = F.lower("text")
    plain = F.when(low.rlike(HINTS[CANDIDATE]), F.regexp_replace(low, CANDIDATE, MARK)).otherwise(low)
    words = texts.where("text IS NOT NULL").select(F.split(plain, r"\s+").alias("w"))
    after = F.arrays_zip(F.slice("w", 2, F.size("w")), "w", F.concat(F.array(F.lit("")), "w"))
    steps = words.select(F.inline(after).alias("next", "one", "two")).where((F.col("next") != "") & ~F.col("next").startswith(MARK))
    pairs = steps.select("next", F.explode(F.array("one", F.concat("two", F.lit(" "), "one"))).alias("pattern"))
    met = pairs.join(patterns.select("pattern").distinct(), "pattern", "left_semi")
    return met.groupBy("pattern").agg(F.approx_count_distinct("next", ERROR).alias("plain"))


def suits(kind: Column, value: Column) -> Column:
    """Whether a candidate's shape suits a kind."""
    ok = F.lit(False)
    for k, shape in SHAPES.items():
        ok = F.when(kind == k, value.rlike(shape)).otherwise(ok)
    return ok


def bootstrap(graph: DataFrame, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """``(value, kind, score)`` of the candidates found. ``graph``: ``(pattern, value, seed,
    size)``, where ``size`` is how many different words and candidates the pattern precedes."""
    seeds = graph.where("seed IS NOT NULL").select("value", F.col("seed").alias("kind")).distinct()
    known = seeds
    for _ in range(rounds):
        hits = graph.join(known, "value").groupBy("pattern", "kind").agg(
            F.count(F.lit(1)).alias("hits"), F.any_value("size").alias("size"))
        trust = hits.withColumn("confidence", F.col("hits") / (F.col("size") + 1)).where(
            (F.col("hits") >= SUPPORT) & (F.col("confidence") >= TRUST)).select("pattern", "kind", "confidence")
        open_ = graph.where("seed IS NULL").join(trust, "pattern").where(suits(F.col("kind"), F.col("value")))
        scores = open_.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        best = scores.groupBy("value").agg(F.max(F.struct("score", "kind")).alias("best")).where(F.col("best.score") >= sure)
        found = stored(best.select("value", "best.kind", "best.score"), "found")
        known = seeds.unionByName(found.select("value", "kind"))
    return found


def extract(docs: DataFrame, keys: Sequence[str], text: str = "text", rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """One row per row of ``docs``: the struct ``row`` of the ``keys``, ``base`` and ``spans``
    (``array<struct<kind, start, end>>`` by kind as listed, then start; ``spans`` holds the
    base ones too)."""
    rows = docs.select(F.struct(*keys).alias("row"), F.md5(F.col(text)).alias("t"), F.col(text).alias("text"))
    read = stored(rows.select("row", "t", base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("seen")), "identifiers")
    found = read.where(F.size("seen") > 0).select("t", "base", F.inline("seen"))
    seen = stored(sightings(found), "sightings")
    plain = plain_followers(rows, seen)
    sizes = seen.select("pattern", "values").distinct().join(plain, "pattern", "left").select(
        "pattern", (F.col("values") + F.coalesce("plain", F.lit(0))).alias("size"))
    graph = stored(seen.drop("values").join(sizes, "pattern"), "pattern-graph")
    more = bootstrap(graph, rounds, sure)
    free = ~F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    added = found.where(F.col("seed").isNull()).join(more, "value").where(free).select("t", F.struct("kind", "start", "end").alias("s"))
    added = added.groupBy("t").agg(F.collect_set("s").alias("added"))
    both = read.select("row", "t", "base").join(added, "t", "left")
    spans = F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")))
    rank = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(rank, s["kind"]).alias("rank"), s["start"].alias("start"),
                                                                   s["end"].alias("end"), s["kind"].alias("kind"))))
    return both.select("row", "base", F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"),
                                                                               s["end"].alias("end"))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", mark: str = "[{kind}]", **how) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind's mark; of overlapping spans
    the first to start counts (then the longer). Columns keep their order."""
    names = docs.columns
    found = extract(docs.select(F.struct(*names).alias("all"), F.col(text).alias("text")), ["all", "text"], **how)
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"), s["kind"].alias("kind"))))
    whole = F.col("row.text")
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        marks = F.concat(*[F.lit(p) if p != "\0" else s["kind"] for p in mark.replace("{kind}", "\1\0\1").split("\1")])
        done = F.struct((-s["minus"]).alias("at"), F.concat(acc["parts"], F.array(piece, marks)).alias("parts"))
        return F.when(s["start"] >= acc["at"], done).otherwise(acc)

    def join(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole)))

    clean = F.when(F.size("spans") > 0, F.aggregate(by_place, none, step, join)).otherwise(whole)
    return found.select(*[clean.alias(c) if c == text else F.col("row.all")[c].alias(c) for c in names])
