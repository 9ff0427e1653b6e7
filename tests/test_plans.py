import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from tokenmill import inputs
from tokenmill.operators.chat import pack
from tokenmill.plans import sampling as S
from tokenmill.plans.index import dense_index, dense_index_by_hash


def keys_df(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_idx"))


def test_dense_index_equals_row_number(spark):
    df = keys_df(spark, 1000).withColumn("k", S.shuffle_key(["doc_id", "chunk_idx"], 42, 0))
    got = dense_index(df, ["k", "doc_id"], num_partitions=7).select("doc_id", "pos")
    want = df.select("doc_id", (F.row_number().over(Window.orderBy("k", "doc_id")) - 1).alias("pos"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_dense_index_per_group(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"))
    got = dense_index(df, ["doc_id"], ["g"], num_partitions=5)
    for r in got.collect():
        assert r.pos == r.doc_id // 3 and r.n_total == 100


def test_shard_pads_by_wrapping(spark):
    base = S.with_epochs(keys_df(spark, 1000), 1)
    sh = S.shard(S.indexed(base, ["doc_id", "chunk_idx"]), 7)
    assert sh.count() == 1001
    sizes = {r.rank: r["count"] for r in sh.groupBy("rank").count().collect()}
    assert sizes == {r: 143 for r in range(7)}
    # the padding copy is the first sample of the order
    first = sh.where("pos = 0").first().doc_id
    assert sh.where("pos = 1000").first().doc_id == first


def test_steps_drop_trailing_group(spark):
    # 10 batches of 1 sample on one rank, G=4: steps 0 and 1, batches 8 and 9 in none
    plan = S.training_plan(keys_df(spark, 10), epochs=1, world_size=1, batch_size=1, grad_accum=4)
    rows = {r.batch_idx: r.opt_step for r in plan.collect()}
    assert rows == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 1, 8: None, 9: None}
    assert plan.first().steps_per_epoch == 2


def test_epochs_differ_and_repeat(spark):
    plan = S.training_plan(keys_df(spark, 50), epochs=2, world_size=1, batch_size=5, grad_accum=2)
    order = {e: [r.doc_id for r in plan.where(f"epoch = {e}").orderBy("pos").collect()] for e in (0, 1)}
    assert order[0] != order[1] and sorted(order[0]) == sorted(order[1])
    again = S.training_plan(keys_df(spark, 50), epochs=2, world_size=1, batch_size=5, grad_accum=2)
    assert [r.doc_id for r in again.where("epoch = 0").orderBy("pos").collect()] == order[0]


def test_resume_skip_rules():
    assert S.resume_skip(7, 5, 8) == 16
    assert S.resume_skip(5, 5, 8) == 0
    assert S.resume_skip(0, 5, 8) == 0


def test_resume_from_strict(spark):
    # 5 steps per epoch, G=8 -> 40 batches of 1 sample per epoch
    plan = S.training_plan(keys_df(spark, 40), epochs=2, world_size=1, batch_size=1, grad_accum=8)
    mid = S.resume_from(plan, 1, 7, grad_accum=8)
    assert mid.where("epoch = 0").agg(F.min("batch_idx")).first()[0] == 16
    rerun = S.resume_from(plan, 1, 5, grad_accum=8)
    assert rerun.where("epoch = 0").count() == 40
    strict = S.resume_from(plan, 1, 5, grad_accum=8, strict=True)
    assert strict.where("epoch = 0").count() == 0 and strict.where("epoch = 1").count() == 40


def test_plan_has_no_single_partition_exchange_over_samples(spark):
    from conftest import physical_plan
    plan = S.training_plan(keys_df(spark, 500), epochs=2, world_size=4, batch_size=8, grad_accum=2)
    text = physical_plan(plan)
    assert "SinglePartition" not in text


def test_next_fit_packing(spark):
    df = spark.createDataFrame([(i, L) for i, L in enumerate([6, 5, 4, 10])], "conv_id long, length long")
    # one shard, order given by a key that follows conv_id: sort by the seeded key instead
    packed = pack(df, 10, ["conv_id"], "length", n_shards=1, seed=42).collect()
    by_key = sorted(packed, key=lambda r: (r.bin, r.bin_offset))
    fills = {}
    for r in by_key:
        fills[r.bin] = fills.get(r.bin, 0) + r.length
    assert all(v <= 10 for v in fills.values()) and len(packed) == 4


def test_next_fit_order(spark):
    from tokenmill.operators.chat import _next_fit
    import pandas as pd
    pdf = pd.DataFrame({"shard": [0, 0, 0, 0], "length": [6, 5, 4, 10]})
    out = next(_next_fit(iter([pdf]), 10, "length"))
    assert out["bin"].tolist() == [0, 1, 1, 2]
    assert out["bin_offset"].tolist() == [0, 0, 5, 0]


def test_dense_index_by_hash_with_hot_group(spark):
    from tokenmill.plans.index import dense_index_by_hash
    # group "a" holds 80% of the rows
    df = spark.range(2000).select(F.col("id").alias("doc_id"),
                                  F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("g"))
    df = df.withColumn("k", S.shuffle_key(["doc_id"], 7, 0))
    got = dense_index_by_hash(df, "k", ["doc_id"], ["g"], num_buckets=16).select("doc_id", "pos", "n_total")
    w = Window.partitionBy("g").orderBy("k", "doc_id")
    want = df.select("doc_id", (F.row_number().over(w) - 1).alias("pos"),
                     F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n_total"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_shard_covers_every_key(spark):
    base = S.with_epochs(keys_df(spark, 997), 1)
    sh = S.shard(S.indexed(base, ["doc_id", "chunk_idx"]), 8)
    assert sh.select("doc_id").distinct().count() == 997
    assert sh.count() == 1000


def test_pack_invariants_on_conversations(spark):
    from conftest import SF001
    from tokenmill import inputs
    from tokenmill.functions.text import split_words
    from tokenmill.operators.chat import render_chat
    items = render_chat(inputs.chat(spark, SF001)).select(
        "conv_id", F.least(F.size(split_words("prompt")), F.lit(300)).cast("bigint").alias("length"))
    packed = pack(items, 300, ["conv_id"], "length", n_shards=3, seed=5)
    rows = packed.collect()
    assert sorted(r.conv_id for r in rows) == sorted(r.conv_id for r in items.collect())
    fill = {}
    for r in rows:
        fill[(r.shard, r.bin)] = fill.get((r.shard, r.bin), 0) + r.length
        assert r.bin_offset + r.length <= 300
    assert max(fill.values()) <= 300


def test_positions_and_packing_do_not_depend_on_layout(spark):
    from tokenmill.plans.index import dense_index_by_hash
    df = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 4).alias("g"))
    df = df.withColumn("k", S.shuffle_key(["doc_id"], 3, 0))
    lengths = spark.range(400).select(F.col("id").alias("conv_id"), (F.col("id") * 7 % 97 + 1).alias("length"))
    results = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, buckets in ((3, 5), (11, 64)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            pos = dense_index_by_hash(df, "k", ["doc_id"], ["g"], num_buckets=buckets).select("doc_id", "pos")
            bins = pack(lengths, 100, ["conv_id"], "length", n_shards=6, seed=1).select("conv_id", "bin", "bin_offset")
            results.append((sorted(pos.collect()), sorted(bins.collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert results[0] == results[1]


@pytest.mark.parametrize("partitions", [3, 40])
def test_positions_are_right_with_payload(spark, partitions):
    """Payload columns, shuffle partitions and AQE merging must not change positions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        docs = inputs.table(spark, SF01, "documents").select("doc_id", "source", "text")
        docs = docs.withColumn("k", S.shuffle_key(["doc_id"], 3, 0))
        got = dense_index_by_hash(docs, "k", ["doc_id"], ["source"]).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == docs.count() and got["text"].notna().all()
    got = got.sort_values(["source", "k", "doc_id"])
    assert (got.groupby("source").cumcount() == got["pos"]).all()
    assert (got.groupby("source")["pos"].transform("size") == got["n_total"]).all()


def test_building_an_index_runs_no_job(spark):
    docs = inputs.table(spark, SF01, "documents").withColumn("k", S.shuffle_key(["doc_id"], 3, 0))
    sc = spark.sparkContext
    sc.setJobGroup("index-build", "index build")
    dense_index_by_hash(docs, "k", ["doc_id"], ["source"])
    jobs = sc.statusTracker().getJobIdsForGroup("index-build")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 0


def test_dense_index_query_carries_no_text_through_the_index(spark, tmp_path, monkeypatch):
    """A text meets its blocks' positions afterwards; ids and rows that come twice, null and empty texts."""
    import hashlib

    from tokenmill.queries import plan_queries as Q
    long = " ".join(f"w{i}" for i in range(600))
    rows = [(1, long), (1, long), (2, "a b"), (2, "c"), (3, None), (3, ""), (3, None), (None, "x"), (4, long + " z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(Q, "dense_index_by_hash", lambda df, *a, **k: seen.append(df.columns) or dense_index_by_hash(df, *a, **k))
    got = [tuple(r) for r in Q.dense_index_q(spark, str(tmp_path)).select("doc_id", "chunk_idx", "text", "pos").collect()]
    assert seen and "text" not in seen[0]
    chunks = lambda t: 1 if len((t or "").split()) <= 256 else len(
        [s for s in range(0, -(-(len(t.split()) - 256) // 128) * 128 + 1, 128) if min(256, len(t.split()) - s) >= 32])
    want = [(d, c, t) for d, u in rows if d for c in range(chunks(u)) for e, t in rows if e == d]
    assert sorted(g[:3] for g in got if g[2] is not None) == sorted(w for w in want if w[2] is not None)
    assert sorted(g[:2] for g in got) == sorted(w[:2] for w in want)
    order = [hashlib.md5(f"{Q.SEED}:0:{d}:{c}".encode()).hexdigest() for d, c, _, _ in sorted(got, key=lambda g: g[3])]
    assert order == sorted(order) and sorted(g[3] for g in got) == list(range(len(want)))
