"""Connected components of an undirected graph by alternating large-star and
small-star rounds (each linear in the edges, with logarithmically many rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.frames import stored


def _all_stars(edges: DataFrame) -> bool:
    """Whether every ``u`` has one ``v``, and no ``v`` is another edge's ``u``."""
    twice = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
    inner = edges.select(F.col("v").alias("u")).join(edges.select("u"), "u", "left_semi")
    return not twice.unionByName(inner).limit(1).count()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns ``u, v`` of one orderable type. Returns ``node, root`` for
    every node of an edge other than a root itself; the root is the component's least
    node. Nulls and loops are left out. A hub's edges are reduced before they are
    shuffled where they are aggregated, and joined with one row where they are not, so
    Spark can split them."""
    e = (edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
         .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    e = stored(e, "edges")
    while not _all_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v")))
        e = stored(small.where("u <> v").distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
