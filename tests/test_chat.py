import math

from pyspark.sql import functions as F

from tokenmill.operators import chat as CH


def sets_df(spark, sizes):
    rows = [(f"s{i}", i * 1000 + j) for i, n in enumerate(sizes) for j in range(n)]
    return spark.createDataFrame(rows, "source string, doc_id long")


def test_interleave_over_counts_and_order(spark):
    df = sets_df(spark, [10, 3, 5])
    probs = {"s0": 0.5, "s1": 0.3, "s2": 0.2}
    out = CH.interleave(df, probs, ["doc_id"]).collect()
    t = max(math.ceil(10 / 0.5), math.ceil(3 / 0.3), math.ceil(5 / 0.2))
    for s, p in probs.items():
        got = [r for r in out if r.source == s]
        assert len(got) == math.ceil(p * t)
        assert sorted(r.r for r in got) == list(range(len(got)))
    assert sorted(r.pos for r in out) == list(range(len(out)))
    by_pos = sorted(out, key=lambda r: r.pos)
    assert all(a.order_key <= b.order_key for a, b in zip(by_pos, by_pos[1:]))


def test_interleave_reuses_rows_cyclically(spark):
    df = sets_df(spark, [2, 8])
    out = CH.interleave(df, {"s0": 0.5, "s1": 0.5}, ["doc_id"]).where("source = 's0'").collect()
    by_r = {r.r: r.doc_id for r in out}
    assert len(by_r) == 8 and all(by_r[r] == by_r[r % 2] for r in by_r)


def test_interleave_under_stops_at_first_exhausted(spark):
    df = sets_df(spark, [10, 3])
    out = CH.interleave(df, {"s0": 0.5, "s1": 0.5}, ["doc_id"], over=False).collect()
    counts = {s: sum(1 for r in out if r.source == s) for s in ("s0", "s1")}
    assert counts == {"s0": 3, "s1": 3}


def test_cap_samples_with_hot_set(spark):
    df = sets_df(spark, [500, 7, 40])
    capped = CH.cap_samples(df, 30, ["doc_id"], ["source"], seed=1)
    counts = {r.source: r["count"] for r in capped.groupBy("source").count().collect()}
    assert counts == {"s0": 30, "s1": 7, "s2": 30}
    # the kept rows are the lowest by seeded key
    keyed = df.withColumn("k", CH.seeded_key(["doc_id"], 1)).where("source = 's0'").orderBy("k", "doc_id")
    want = {r.doc_id for r in keyed.limit(30).collect()}
    assert {r.doc_id for r in capped.where("source = 's0'").collect()} == want


def test_train_val_split_with_repeated_and_null_keys(spark):
    rows = [(i % 40 if i % 7 else None, f"t{i}") for i in range(103)]
    df = spark.createDataFrame(rows, "conv_id long, text string")
    out = CH.train_val_split(df, 10, ["conv_id"]).collect()
    assert len(out) == 103 and sum(r.split == "val" for r in out) == 10
    assert sorted(r.text for r in out) == sorted(t for _, t in rows)


def test_pack_keeps_other_columns(spark):
    df = spark.range(200).select(F.col("id").alias("conv_id"), (F.col("id") % 50 + 1).alias("length"),
                                 F.concat(F.lit("t"), F.col("id")).alias("text"))
    whole = {(r.conv_id, r.shard, r.bin, r.bin_offset): r.text for r in CH.pack(df, 64, ["conv_id"], n_shards=4).collect()}
    narrow = CH.pack(df.drop("text"), 64, ["conv_id"], n_shards=4)
    assert len(whole) == 200 and all(t == f"t{k[0]}" for k, t in whole.items())
    assert set(whole) == {(r.conv_id, r.shard, r.bin, r.bin_offset) for r in narrow.collect()}


def test_pack_returns_each_row_once(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 7, "c"), (None, 3, "d"), (None, 3, "d"), (2, 64, None), (3, 1, "e"), (3, 1, "e")]
    df = spark.createDataFrame(rows, "conv_id long, length long, text string").repartition(3)
    got = CH.pack(df, 64, ["conv_id"], n_shards=2).collect()
    assert sorted(((r.conv_id, r.length, r.text) for r in got), key=str) == sorted(rows, key=str)
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append((r.bin_offset, r.length))
    for parts in bins.values():  # gapless, and within the capacity
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0 and sum(parts[-1]) <= 64
    bare = CH.pack(df.drop("text"), 64, ["conv_id"], n_shards=2).collect()
    assert sorted((r.shard, r.bin, r.bin_offset, r.length) for r in bare) == sorted((r.shard, r.bin, r.bin_offset, r.length) for r in got)


def test_render_chat_orders_turns(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a")],
                               "conv_id long, turn long, role string, text string")
    got = CH.render_chat(df, add_generation_prompt=True).first().prompt
    assert got == ("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"
                   "<|im_start|>assistant\n")


def test_turns_without_a_conversation_are_prompts_of_their_own(spark):
    df = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, None, None), (5, 0, "user", "b")],
                               "conv_id long, turn long, role string, text string")
    got = sorted(((r.conv_id, r.prompt, r.turns) for r in CH.render_chat(df).collect()), key=str)
    a, none = "<|im_start|>user\na<|im_end|>\n", "<|im_start|>\n<|im_end|>\n"
    assert got == sorted([(None, a, 1), (None, a, 1), (None, none, 1), (5, a.replace("a<|im_end", "b<|im_end"), 1)], key=str)


import pytest


@pytest.mark.parametrize("sizes,weights,over", [
    ([37, 11, 23, 5], [0.4, 0.3, 0.2, 0.1], True),
    ([9, 9, 4], [0.5, 0.5, 0.25], True),          # equal weights: every key ties
    ([50, 3, 17], [0.7, 0.13, 0.17], False),
    ([101, 64, 7], [1 / 3, 1 / 3, 1 / 3], True),
])
def test_interleave_positions_equal_a_global_sort(spark, sizes, weights, over):
    from pyspark.sql import Window
    df = sets_df(spark, sizes)
    probs = {f"s{i}": w for i, w in enumerate(weights)}
    out = CH.interleave(df, probs, ["doc_id"], over=over)
    idx = {s: i for i, s in enumerate(probs)}
    set_idx = F.create_map(*[x for s, i in idx.items() for x in (F.lit(s), F.lit(i))])[F.col("source")]
    want = out.select("source", "r", (F.row_number().over(Window.orderBy("order_key", set_idx)) - 1).alias("p"))
    got = {(r.source, r.r): r.pos for r in out.collect()}
    assert got == {(r.source, r.r): r.p for r in want.collect()}
