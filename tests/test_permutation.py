import pytest
from pyspark.sql import functions as F

from conftest import SF001, physical_plan
from tokenmill.operators import blocks as B
from tokenmill.plans import permutation as P
from tokenmill.plans import sampling as S
from tokenmill.queries import plan_queries as Q


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 100, 1000, 65537])
def test_a_permutation_and_its_inverse(spark, n):
    df = spark.range(n).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1), F.lit(7))))
    df = P.permute(P.permute(df, "id", n, "y", 42, F.col("epoch")), "y", n, "x", 42, F.col("epoch"), inverse=True)
    got = df.groupBy("epoch").agg(F.count_distinct("y").alias("d"), F.min("y").alias("lo"), F.max("y").alias("hi"),
                                  F.sum((F.col("x") != F.col("id")).cast("int")).alias("wrong")).collect()
    assert all((r.d, r.lo, r.hi, r.wrong) == (n, 0, n - 1, 0) for r in got) and len(got) == 3


def test_large_numbers_and_seeds(spark):
    for n in (2**31 - 1, 10**12 + 39, 2**62):
        xs = [0, 1, 2, n // 2, n - 2, n - 1]
        df = spark.createDataFrame([(x,) for x in xs], "x long")
        rows = P.permute(P.permute(df, "x", n, "y", 5, 3), "y", n, "z", 5, 3, inverse=True).collect()
        assert all(r.x == r.z and 0 <= r.y < n for r in rows) and len({r.y for r in rows}) == len(xs)
    a, b, c = (P.permute(spark.range(500), "id", 500, "y", s, e).toPandas().y.tolist() for s, e in ((1, 0), (1, 1), (2, 0)))
    assert sum(x == y for x, y in zip(a, b)) < 20 and sum(x == y for x, y in zip(a, c)) < 20


def test_the_order_is_mixed(spark):
    """Neighbours land far apart, and every tenth of the order is fed by all of the input."""
    n = 20_000
    y = P.permute(spark.range(n), "id", n, "y").orderBy("id").toPandas().y.to_numpy()
    import numpy as np
    assert 0.3 * n < np.abs(np.diff(y)).mean() < 0.37 * n  # a third, for a random order
    table = np.histogram2d(np.arange(n), y, bins=10)[0]
    assert table.min() > 140 and table.max() < 260  # 200 each
    assert abs(np.corrcoef(np.arange(n), y)[0, 1]) < 0.03


def test_one_shuffle_for_any_number_of_epochs(spark):
    keys = Q.sample_keys(spark, SF001)
    plan = physical_plan(P.permuted_plan(keys, Q.KEYS, 5, 4, 8, 4))
    assert "Exchange" not in plan.replace("TableCacheQueryStage", "") or plan.count("Exchange hashpartitioning") <= 1
    indexed = keys.withColumn("idx", F.monotonically_increasing_id())
    assert "Exchange" not in physical_plan(P.permuted_plan(indexed, Q.KEYS, 5, 4, 8, 4, index="idx", n=1000))
    assert "Exchange" not in physical_plan(P.resume_places(spark, 1000, 1, 7, 5, 4, 8, 4))


@pytest.mark.parametrize("n,world,size,accum,drop", [(37, 4, 3, 2, None), (37, 1, 5, 3, None), (1, 3, 2, 1, None)])
def test_places_equal_the_plan(spark, n, world, size, accum, drop):
    keys = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_idx"))
    plan = P.permuted_plan(keys, Q.KEYS, 3, world, size, accum, drop_last=drop)
    cols = [c for c in plan.columns if c not in Q.KEYS]
    rows = sorted(map(tuple, plan.select(*cols).collect()), key=str)
    got = [r for e in range(3) for r in map(tuple, P.epoch_places(spark, n, e, 0, None, world, size, accum, drop_last=drop).select(*cols).collect())]
    assert sorted(got, key=str) == rows
    spe = plan.first().steps_per_epoch if rows else 0
    for epoch, step in ((1, 0), (1, 1), (2, spe + 1), (3, 3 * spe)):
        want = S.resume_from(plan, epoch, step, spe, accum).select(*cols).collect()
        left = P.resume_places(spark, n, epoch, step, 3, world, size, accum, drop_last=drop).select(*cols).collect()
        assert sorted(map(tuple, left), key=str) == sorted(map(tuple, want), key=str)
    assert all(r[cols.index("idx")] < n for r in got)


def test_samples_of_a_step_by_index(spark):
    """The samples of one optimizer step, fetched from a stored set by index."""
    import os
    import tempfile

    from tokenmill import inputs
    from tokenmill.sources import blocksets
    path = os.path.join(tempfile.mkdtemp(prefix="tokenmill-test-"), "set")
    blk = B.build_blocks(inputs.table(spark, SF001, "documents"), "text", 64, 32, 8)
    n = blocksets.write_indexed(blk, path, Q.KEYS, rows_per_slice=100)
    places = P.epoch_places(spark, n, 1, 4, 8, 2, 3, 4)  # step 1 of two ranks: four batches of three
    assert {r.opt_step for r in places.collect()} == {1} and places.count() == 24
    got = blocksets.sample_at(spark, path, places.select("idx"))
    want = P.permuted_plan(blk.select(*Q.KEYS), Q.KEYS, 2, 2, 3, 4).where("epoch = 1 AND opt_step = 1")
    assert sorted(r.pos for r in got.collect()) == sorted(r.idx for r in want.collect())
