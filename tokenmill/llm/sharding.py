"""Rendezvous hashing of record keys over weighted shards.

A record goes to the shard with the highest score ``-weight / ln(u)``, where u in
(0, 1) comes from the md5 of key and shard. Adding a shard moves a record only if the
new shard scores highest, and only into it; a shard's share follows its weight. The
shard of a record depends on nothing but its key and the shards.

A null key is the key "null" of its own; repeated keys share a shard. No shard's rows
are gathered: places within a shard come from the distributed dense index. Texts and
other columns, however long, only pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.frames import free_name
from tokenmill.plans.index import dense_index_by_hash


def _scores(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """A struct of score and minus shard for each of the shards from ``first`` on."""
    if not weights or min(weights) <= 0:
        raise ValueError("positive weights are needed")
    shards = F.sequence(F.lit(first), F.lit(first + len(weights) - 1))

    def score(s: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.coalesce(key, F.lit("null")), s.cast("string")))
        unit = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(2.0**48)
        if len(set(weights)) == 1:
            weight = F.lit(float(weights[0]))
        else:
            weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), s - first)
        return F.struct((-weight / F.ln(unit)).alias("score"), (-s).alias("shard"))

    return F.transform(shards, score)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a string key; ties go to the lower one."""
    return -F.array_max(_scores(key, weights))["shard"]


def shard_rows(df: DataFrame, key: str, weights: Sequence[float], grown_weight: float | None = None) -> DataFrame:
    """``df`` plus ``shard``, ``slot`` (gapless from 0 in the shard, in the order of the
    key's hash) and ``grown_shard`` (the shard once another of ``grown_weight``, by
    default the last one's weight, is added). Columns of these names are replaced."""
    name = F.col(key).cast("string")
    added = [weights[-1] if grown_weight is None else grown_weight]
    mine = df.drop("shard", "slot", "grown_shard")
    best, h = free_name(mine.columns, "best"), free_name(mine.columns, "key_hash")
    placed = (mine.withColumn(best, F.array_max(_scores(name, weights)))
              .withColumn("shard", -F.col(best)["shard"])
              .withColumn("grown_shard", -F.greatest(F.col(best), _scores(name, added, len(weights))[0])["shard"])
              .withColumn(h, F.md5(F.coalesce(name, F.lit("null")))).drop(best))
    rest = [c for c, kind in mine.dtypes if not kind.startswith("map")]
    return dense_index_by_hash(placed, h, rest, ["shard"], out="slot", total=None).drop(h)
