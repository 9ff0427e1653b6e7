"""Quality rules as weak supervision.

Each rule votes good, votes bad or abstains on a document. A rule that looks for a fault
says nothing of texts without it, since a text with one fault is mostly free of the
others; so fault rules vote bad or abstain, and separate rules vote good or abstain.
Expectation-maximisation over all documents' votes estimates how often every rule casts
each vote on good and on bad documents, hence how accurate its votes are; a document's
posterior probability of being good follows from its votes. One stray vote need not
cost a document its place, as it would if all rules had to pass.

The votes of a document are one of at most 3^rules patterns, so the corpus enters EM
as a table of pattern counts of bounded size: counted by Spark over all documents,
iterated on the driver, joined back. The features are computed in one pass over the
text and stored, so the text is read once.

Words are maximal runs of characters other than space and \\t to \\r. Null and empty
texts have no words: the ratio rules abstain, and the base rule on length fails them.
Repeated rows are judged as the separate rows they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.frames import free_name, map_batches, stored, text_chunks

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_letters", "n_upper", "n_marks", "n_bytes")
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_HIGH = bytes(range(128, 256))


def features_of(text: str | None) -> tuple[int, ...]:
    """The counts named in ``FEATURES``; letters are ASCII letters and non-ASCII bytes."""
    if not text:
        return (0,) * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes split at ASCII white space only
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            inside = np.zeros(len(words) + 1, np.int64)
            at = np.array([i for i, w in enumerate(windows) if seen[w] > 1], np.int64)
            np.add.at(inside, at, 1)
            np.add.at(inside, at + 3, -1)
            repeated = int((np.cumsum(inside) > 0).sum())
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = upper + len(data) - len(data.translate(None, _LOWER + _HIGH))
    return (len(words), chars, sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), repeated,
            len(lines), letters, upper, text.count("!") + text.count("?"),
            len(data) - sum(data.count(c) for c in _SPACE))


def features(docs: DataFrame, keep: Sequence[str], text: str = "text", out: str = "features") -> DataFrame:
    """The ``keep`` columns and a struct ``out`` of ``FEATURES`` (replacing a column of that name)."""
    keep = [c for c in keep if c != out]
    kind = T.StructType([T.StructField(n, T.LongType()) for n in FEATURES])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(out, kind)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, text):
                rows = [features_of(t) for t in batch.column(text).to_numpy(zero_copy_only=False)]
                values = np.array(rows, np.int64).reshape(len(rows), len(FEATURES))
                struct = pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(len(FEATURES))], list(FEATURES))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), struct], [*keep, out])

    return map_batches(docs, list(dict.fromkeys([*keep, text])), schema, count)


@dataclass(frozen=True)
class Rule:
    """Votes ``vote`` (bad or good) if ``when`` holds, else abstains."""
    name: str
    vote: str
    when: str


#: Over the features; thresholds follow the published web-corpus heuristics.
RULES = (
    Rule("word_length", "bad", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    Rule("symbols", "bad", "n_symbols > 0.1 * n_words"),
    Rule("few_letters", "bad", "n_letters < 0.7 * n_bytes"),
    Rule("repeated_lines", "bad", "n_dup_lines > 0.4 * n_lines"),
    Rule("repeated_words", "bad", "n_repeat_words > 0.4 * n_words"),
    Rule("upper_case", "bad", "n_upper > 0.4 * n_letters"),
    Rule("marks", "bad", "n_marks > 0.3 * n_words"),
    Rule("prose", "good", "n_letters >= 0.8 * n_bytes AND word_chars BETWEEN 3.5 * n_words AND 8 * n_words "
                          "AND n_symbols <= 0.05 * n_words"),
    Rule("varied", "good", "n_repeat_words <= 0.1 * n_words AND n_dup_lines <= 0.1 * n_lines"),
)


def votes(rules: Sequence[Rule], out: str = "features") -> Column:
    """A letter per rule, in order: g, b or a dash for abstention. Texts without words
    get dashes only."""
    def vote(rule: Rule) -> Column:
        named = {n: f"`{out}`.`{n}`" for n in FEATURES}
        def expr(text):
            return F.expr(" ".join(named.get(w, w) for w in text.split(" ")))
        return F.when(F.col(f"{out}.n_words") == 0, "-").when(expr(rule.when), rule.vote[0]).otherwise("-")
    return F.concat(*[vote(r) for r in rules])


@dataclass
class VoteModel:
    """``good``: share of good documents; ``cast[c, j]``: chances that rule j says good,
    says bad or abstains on documents of class c (0 good, 1 bad)."""
    good: float
    cast: np.ndarray
    rounds: int

    def posterior(self, patterns: Sequence[str]) -> np.ndarray:
        """Probability of good for each pattern."""
        v = _codes(patterns, self.cast.shape[1])
        like = np.log(self.cast[:, np.arange(v.shape[1]), v]).sum(2)
        odds = np.log((1 - self.good) / self.good) + like[1] - like[0]
        return 1 / (1 + np.exp(np.clip(odds, -700, 700)))

    def accuracy(self) -> np.ndarray:
        """For each rule, the chance that its vote names the document's class."""
        share = np.array([self.good, 1 - self.good])
        right = share[0] * self.cast[0, :, 0] + share[1] * self.cast[1, :, 1]
        return right / (share[:, None, None] * self.cast[:, :, :2]).sum((0, 2))


def _codes(patterns: Sequence[str], n_rules: int) -> np.ndarray:
    return np.array([["gb-".index(x) for x in p] for p in patterns], np.int64).reshape(len(patterns), n_rules)


def fit_votes(patterns: Sequence[str], counts: Sequence[int], rules: Sequence[Rule], rounds: int = 200,
              tolerance: float = 1e-9) -> VoteModel:
    """EM over vote patterns weighted by their counts. Votes start out mostly right: a
    fault rule fires on a quarter of the bad documents and a hundredth of the good ones,
    a good rule on nine tenths of the good and a third of the bad; these beliefs weigh
    as much as ten documents, which also fixes which class is the good one."""
    bad = np.array([r.vote == "bad" for r in rules])
    start = np.zeros((2, len(rules), 3))
    for c, (fires_good, fires_bad) in enumerate(((0.9, 0.01), (0.33, 0.25))):
        fires = np.where(bad, fires_bad, fires_good)
        start[c] = np.stack([np.where(bad, 0.001, fires), np.where(bad, fires, 0.001), 1 - fires], 1)
    start /= start.sum(2, keepdims=True)
    model = VoteModel(0.8, start, 0)
    if not len(patterns):
        return model
    n = np.asarray(counts, float)
    votes_ = np.eye(3)[_codes(patterns, len(rules))]  # pattern, rule, vote
    for k in range(1, rounds + 1):
        p = model.posterior(patterns)
        both = np.stack([p * n, (1 - p) * n])
        cast = np.einsum("cp,pjv->cjv", both, votes_) + 10 * start
        new = VoteModel(float((both[0].sum() + 8) / (n.sum() + 10)), cast / cast.sum(2, keepdims=True), k)
        change = max(abs(new.good - model.good), np.abs(new.cast - model.cast).max())
        model = new
        if change < tolerance:
            break
    return model


def judge(docs: DataFrame, keep: Sequence[str], text: str = "text", rules: Sequence[Rule] = RULES,
          threshold: float = 0.5, out: str = "quality") -> DataFrame:
    """The ``keep`` columns and the struct ``out``: the features, ``votes``,
    ``probability`` (posterior of good), ``base_failed`` (under 50 words, or over half
    of the words in repeated three-word windows) and ``kept`` (not failed and
    probability at least ``threshold``)."""
    spark = docs.sparkSession
    names = [c for c in keep if c != out]
    f, cast, p = (free_name(names, x) for x in ("features", "votes", "posterior"))
    voted = stored(features(docs, names, text, f).withColumn(cast, votes(rules, f)), "quality-features")
    table = voted.groupBy(cast).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^rules patterns
    counts = {r[0]: r[1] for r in table}
    patterns = sorted(counts)
    model = fit_votes(patterns, [counts[x] for x in patterns], rules)
    known = spark.createDataFrame(list(zip(patterns, model.posterior(patterns).tolist())) if patterns else [],
                                  T.StructType([T.StructField(cast, T.StringType()), T.StructField(p, T.DoubleType())]))
    n = {x: F.col(f)[x] for x in FEATURES}
    failed = (n["n_words"] < 50) | (100 * n["n_repeat_words"] > 50 * n["n_words"])
    judged = F.struct(*[n[x].alias(x) for x in FEATURES], F.col(cast).alias("votes"),
                      F.col(p).alias("probability"), failed.alias("base_failed"),
                      (~failed & (F.col(p) >= threshold)).alias("kept"))
    return voted.join(F.broadcast(known), cast).select(*names, judged.alias(out))


def keep_good(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that the rules reject."""
    out = free_name(docs.columns, "quality")
    return judge(docs, docs.columns, text, out=out, **how).where(F.col(out)["kept"]).select(*docs.columns)
