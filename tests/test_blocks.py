from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenmill.functions.arrays import attention_mask, labels_from_ids, pad_right
from tokenmill.operators import blocks as B


def reference_loop(n, length, stride, min_len):
    """Plain restatement of the sliding-window loop: list of (start, width)."""
    if n <= length:
        return [(0, n)]
    out, start = [], 0
    while start < n:
        end = start + length
        width = min(end, n) - start
        if width < min_len:
            break
        out.append((start, width))
        if end >= n:
            break
        start += stride
    return out


def blocks_of(spark, ns, length, stride, min_len):
    df = spark.createDataFrame([(i, list(range(100, 100 + n))) for i, n in enumerate(ns)],
                               "doc_id long, input_ids array<long>")
    out = B.chunk(df, "input_ids", length, stride, min_len, pad_id=0)
    res = {i: [] for i in range(len(ns))}
    for r in out.orderBy("doc_id", "chunk_idx").collect():
        width = sum(r.attention_mask)
        start = r.input_ids[0] - 100 if width else 0
        assert len(r.input_ids) == length and len(r.attention_mask) == length
        assert r.input_ids[width:] == [0] * (length - width)
        res[r.doc_id].append((start, width))
    return [res[i] for i in range(len(ns))]


def test_fixture_cases(spark):
    assert blocks_of(spark, [0, 1, 8], 8, 4, 3) == [[(0, 0)], [(0, 1)], [(0, 8)]]
    assert blocks_of(spark, [9, 12, 13], 8, 4, 3) == [[(0, 8), (4, 5)], [(0, 8), (4, 8)],
                                                       [(0, 8), (4, 8), (8, 5)]]
    assert blocks_of(spark, [9, 10, 15], 8, 7, 3) == [[(0, 8)], [(0, 8), (7, 3)], [(0, 8), (7, 8)]]
    assert blocks_of(spark, [5, 6, 7], 4, 6, 1) == [[(0, 4)], [(0, 4)], [(0, 4), (6, 1)]]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=12), st.integers(1, 12), st.integers(1, 12),
       st.integers(0, 14))
def test_chunk_matches_loop(spark, ns, length, stride, min_len):
    want = [reference_loop(n, length, stride, min_len) for n in ns]
    assert blocks_of(spark, ns, length, stride, min_len) == want


def test_pad_mask_labels(spark):
    df = spark.createDataFrame([([5, 0, 7, 0],)], "ids array<long>")
    r = df.select(labels_from_ids("ids", 0).alias("lab"), pad_right("ids", 6, 0).alias("p"),
                  attention_mask(F.lit(2), 5).alias("m")).first()
    assert r.lab == [5, -100, 7, -100]
    assert r.p == [5, 0, 7, 0, 0, 0]
    assert r.m == [1, 1, 0, 0, 0]


def test_labels_by_mask(spark):
    df = spark.createDataFrame([([5, 0, 7, 0], [1, 1, 1, 0])], "input_ids array<long>, attention_mask array<int>")
    assert B.with_labels(df, 0, by="mask").first().labels == [5, 0, 7, -100]


def test_blocks_stage_is_narrow_and_native(spark):
    from conftest import SF001, physical_plan
    from tokenmill import inputs
    plan = physical_plan(B.build_blocks(inputs.table(spark, SF001, "documents"), "text", 256, 128, 32))
    assert "Exchange" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_token_ids_are_stable(spark):
    df = spark.createDataFrame([("a b\tc\nd a",)], "text string")
    ids = B.tokenize(df).first().input_ids
    assert len(ids) == 5 and ids[0] == ids[4] and all(16 <= i < 50016 for i in ids)


def test_padding_report_keys_equal_blocks(spark):
    from conftest import SF001
    from tokenmill import inputs
    docs = inputs.table(spark, SF001, "documents")
    a = B.padding_report(B.build_blocks(docs, "text", 64, 32, 8)).first()
    b = B.padding_report(B.block_keys(docs, "text", 64, 32, 8), length=64).first()
    assert a == b


def test_a_very_long_document_is_sliced_row_by_row(spark):
    """Blocks are rows of a generator over the starts, not one array of all of them."""
    from conftest import physical_plan
    n = 2_000_000
    df = spark.range(1).select(F.lit(7).alias("doc_id"), F.sequence(F.lit(1).cast("bigint"), F.lit(n).cast("bigint")).alias("ids"))
    out = B.chunk(df, "ids", 2048, 1024, 256)
    plan = physical_plan(out)
    assert "posexplode" in plan and "inline" not in plan and "Exchange" not in plan
    got = out.agg(F.count(F.lit(1)).alias("blocks"), F.max("chunk_idx").alias("last"), F.sum(F.aggregate(
        "attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("real"), F.max(F.array_max("input_ids")).alias("top")).first()
    want = [s for s in range(0, n, 1024) if s == 0 or (s < n and min(2048, n - s) >= 256 and s <= -(-(n - 2048) // 1024) * 1024)]
    assert (got.blocks, got.last, got.top) == (len(want), len(want) - 1, n)
    assert got.real == sum(min(2048, n - s) for s in want)
