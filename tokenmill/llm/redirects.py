"""URL filter by redirect equivalence.

Rules allow or block a host with its subdomains, below a path prefix; the longest rule
that fits a url decides it. Urls joined by redirects or canonical links are aliases: a
block decided by rule anywhere in a connected component passes to its members that no
rule decides. An explicit allow takes precedence for the url it fits: it is never
overridden by a propagated block (and, being about that url, does not lift the block
from its aliases). Everything else is allowed.

Rules meet urls by equality: a url is looked up under each of its host's suffixes
joined with each prefix of its path that has the length of some rule's path, so one
host with many rules or many urls makes no product.

Urls are one node if they differ only in the case of scheme or host. Link targets are
read as a browser would: HTML entities are resolved, then the target against the page's
url or its ``<base>``.

Null urls, and urls without ``://``, have an empty host and path, no rule and no
aliases, and are allowed. Repeated rows each have their result; a url is judged once,
however many pages have it or however long it is. An empty table gives no rows.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.components import connected_components
from tokenmill.llm.frames import free_name

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^?#]*", 0)
    host = F.regexp_extract(rest, r"(?s)^[^/]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def resolved(target: str, base: str, url: str) -> str | None:
    """The absolute url of a link target on the page ``url`` with the ``<base>`` given
    (or ''), both as written in HTML; None without one. Absolute targets stay as they are."""
    target, base = markup.unescape(target), markup.unescape(base)
    try:
        found = target if _ABSOLUTE.match(target) else urljoin(urljoin(url, base), target)
    except ValueError:  # no host can be read
        return None
    return found if _ABSOLUTE.match(found) else None


def node_key(url: Column) -> Column:
    """A url with scheme and host in lower case; null and urls without ``://`` as they are."""
    at = F.instr(url, "://")
    host, _ = split_url(url)
    rest = F.substring(url, at + 3 + F.length(host), F.length(url))
    return F.when(at > 0, F.concat(F.translate(F.substring(url, F.lit(1), at - 1), _UPPER, _LOWER), F.lit("://"), host, rest)).otherwise(url)


def _resolved(targets: pd.Series, bases: pd.Series, urls: pd.Series) -> pd.Series:
    return pd.Series([resolved(t, b, u) for t, b, u in zip(targets, bases, urls)], dtype=object)


def canonical_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(u, v)`` of pages that name another url: ``rel=canonical`` links and ``refresh``
    redirects; targets are resolved against the page's url, or its ``<base>``."""
    tag = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
    named = F.concat(F.regexp_extract_all(html, F.lit(tag), F.lit(1)), F.regexp_extract_all(html, F.lit(refresh), F.lit(1)))
    # most pages have neither word, and a plain search is much cheaper than the patterns
    low = F.lower(F.col(html))
    likely = F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    found = pages.where(likely & F.col(url).isNotNull()).select(F.col(url).alias("u"), base.alias("b"), F.explode(named).alias("v"))
    absolute = F.pandas_udf(_resolved, "string")  # a batch at a time, on the different links only
    return found.distinct().select("u", absolute("v", "b", "u").alias("v")).where("v IS NOT NULL")


def rule_table(spark, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``(rule, verdict)`` with rules such as ``example.com/en/``; hosts are lower-cased.
    The same rule given twice is blocked only if no entry allows it."""
    rows = [(r.split("/")[0].translate(str.maketrans(_UPPER, _LOWER)) + r[len(r.split("/")[0]):], v) for r, v in rules]
    return (spark.createDataFrame(rows, "rule string, verdict string")
            .groupBy("rule").agg(F.min("verdict").alias("verdict")))  # allow sorts before block


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Distinct ``url, host, path, rule, verdict`` (the longest rule's, or nulls)."""
    host, path = split_url(F.col("url"))
    parts = urls.select(F.col(url).alias("url")).distinct().select("url", host.alias("host"), path.alias("path"))
    ends = rules.select((F.length("rule") - F.instr("rule", "/") + 1).alias("n")).distinct().collect()  # lengths of rules' paths
    lengths = F.array(*[F.lit(n) for n in sorted(r["n"] for r in ends)]).cast("array<int>")
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)),
                         lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    names = F.flatten(F.transform(fitting, lambda n: F.transform(suffix, lambda s: F.concat(s, F.substring(F.col("path"), F.lit(1), n)))))
    looked = parts.where("host <> '' AND path <> ''").select("url", F.explode(names).alias("rule")).join(rules, "rule")
    best = looked.groupBy(F.col("url").alias("of")).agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("b"))
    return parts.join(best, F.col("url") == F.col("of"), "left").select(
        "url", "host", "path", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, links: DataFrame, keep: Sequence[str], url: str = "url") -> DataFrame:
    """The ``keep`` columns of ``pages`` with ``host``, ``path``, ``rule``, ``verdict``
    and ``alias_of`` (the least node of the component, null without aliases), which
    replace columns of these names. ``links``: ``(u, v)`` pairs of urls; their ends
    need not be pages, and rules decide them all the same."""
    roots = connected_components(links.select(node_key(F.col("u")).alias("u"), node_key(F.col("v")).alias("v")))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    every = pages.select(node_key(F.col(url)).alias("url")).union(roots.select("node")).distinct()
    matched = match_rules(every, rules)
    joined = matched.join(roots, F.col("url") == F.col("node"), "left").drop("node")
    blocked = joined.where("root IS NOT NULL AND verdict = 'block'").select(F.col("root").alias("r"), F.lit(True).alias("b")).distinct()
    told = joined.join(blocked, F.col("root") == F.col("r"), "left")
    verdict = F.coalesce("verdict", F.when(F.col("b"), F.lit("block")), F.lit("allow"))
    new = ("host", "path", "rule", "verdict", "alias_of")
    told = told.select(F.col("url").alias("of"), F.struct("host", "path", "rule", verdict.alias("verdict"), F.col("root").alias("alias_of")).alias("told"))
    names = [c for c in keep if c not in new]
    mine = pages.select(F.struct(*names, F.lit(0).alias(free_name(names, "none"))).alias("row"), node_key(F.col(url)).alias("url"))
    met = mine.join(told, F.col("url").eqNullSafe(F.col("of")))
    return met.select(*[F.col("row")[c].alias(c) for c in names], "told.*")
