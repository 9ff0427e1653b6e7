import math

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import classify as C


def test_bucket_boundaries(spark):
    scores = [0.5999, 0.6, 0.7499, 0.75, 1.0, 1.0001, None, math.nan]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, score double")
    got = {r.i: r.bucket for r in C.classify(df, keep_unbinned=True).collect()}
    low, high = "score_0.6_to_0.75", "score_0.75_to_1.0"
    assert [got[i] for i in range(len(scores))] == [None, low, low, high, high, None, None, None]
    assert C.classify(df).count() == 4


def test_null_source_is_its_own_group(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "source string, x int")
    assert C.filter_source(df, None).count() == 2
    assert C.filter_source(df, "a").count() == 1
    assert C.distinct_sources(df).count() == 2


def test_filters_half_open_and_closed(spark):
    df = spark.createDataFrame([(0.6,), (0.75,), (1.0,)], "score double")
    assert C.filter_score(df, 0.6, 0.75).count() == 1
    assert C.filter_score(df, 0.75, 1.0, closed=True).count() == 2
    assert C.filter_score(df, 0.75, 1.0).count() == 1


def test_bins_must_not_overlap():
    with pytest.raises(ValueError):
        C.score_bucket("score", [(0.5, 0.8), (0.7, 1.0)])


def test_classify_is_one_pass_without_shuffle(spark):
    from conftest import SF001, physical_plan
    from tokenmill import inputs
    plan = physical_plan(C.classify(inputs.corpus(spark, SF001)).where(F.col("bucket") == C.HIGH_BUCKET))
    assert "Exchange" not in plan and "BatchEvalPython" not in plan


def test_source_distribution_shares(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "source string")
    rows = C.source_distribution(df).collect()
    assert [(r.source, r.rows, round(r.pct, 2)) for r in rows] == [("a", 3, 75.0), ("b", 1, 25.0)]
