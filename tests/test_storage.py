import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001, physical_plan
from tokenmill import inputs
from tokenmill.operators import blocks as B
from tokenmill.operators import classify as C
from tokenmill.sources import blocksets, classified, files, fs


def new_dir():
    return tempfile.mkdtemp(prefix="tokenmill-test-")


def n_files(root):
    return sum(len([f for f in fs_ if not f.startswith(".")]) for _, _, fs_ in os.walk(root))


def test_skip_existing_adds_nothing(spark):
    root = os.path.join(new_dir(), "c")
    rows = C.classify(inputs.corpus(spark, SF001))
    classified.write_classified(rows, root)
    before = n_files(root)
    classified.write_classified(rows, root, on_existing="skip")
    assert n_files(root) == before
    assert classified.read_classified(spark, root).count() == rows.count()


def test_read_bucket_prunes_partitions(spark):
    root = os.path.join(new_dir(), "c")
    classified.write_classified(C.classify(inputs.corpus(spark, SF001)), root)
    df = classified.read_bucket(spark, root, C.HIGH_BUCKET)
    plan = physical_plan(df)
    assert "PartitionFilters: [isnotnull(bucket" in plan and C.HIGH_BUCKET in plan
    assert df.select("bucket").distinct().count() == 1


def test_source_without_band_is_absent(spark):
    root = os.path.join(new_dir(), "c")
    df = spark.createDataFrame([("a", 0.9, "t"), ("b", 0.65, "t")], "source string, score double, text string")
    classified.write_classified(C.classify(df), root)
    got = classified.read_bucket(spark, root, C.HIGH_BUCKET).collect()
    assert [r.source for r in got] == ["a"]


def test_missing_root_raises(spark):
    with pytest.raises(FileNotFoundError):
        classified.read_bucket(spark, "/nonexistent/tokenmill", C.HIGH_BUCKET)


def test_block_sets_errors_and_skips(spark):
    parent = new_dir()
    with pytest.raises(ValueError):
        blocksets.read_block_sets(spark, parent)  # no sub-directory
    fs.mkdirs(spark, os.path.join(parent, "bad"))
    with pytest.raises(ValueError):
        blocksets.read_block_sets(spark, parent)  # nothing loads
    blk = B.build_blocks(inputs.table(spark, SF001, "documents"), "text", 64, 32, 8)
    blocksets.write_blocks(blk, os.path.join(parent, "good"))
    assert blocksets.read_block_sets(spark, parent).count() == blk.count()


def test_size_report_sums_file_lengths(spark):
    root = os.path.join(new_dir(), "c")
    classified.write_classified(C.classify(inputs.corpus(spark, SF001)), root)
    rep = files.size_report(spark, root, C.HIGH_BUCKET).collect()
    on_disk = 0
    for src in {r.source for r in rep}:
        leaf = os.path.join(root, f"source={src}", f"bucket={C.HIGH_BUCKET}")
        on_disk += sum(os.path.getsize(os.path.join(leaf, f)) for f in os.listdir(leaf) if not f.startswith("."))
    assert sum(r.bytes for r in rep) == on_disk
    assert abs(sum(r.pct for r in rep) - 100.0) < 1e-9
    assert [r.bytes for r in rep] == sorted((r.bytes for r in rep), reverse=True)


def test_file_sizes_do_not_read_content(spark):
    root = os.path.join(new_dir(), "c")
    classified.write_classified(C.classify(inputs.corpus(spark, SF001)), root)
    plan = physical_plan(files.file_sizes(spark, root))
    assert "content" not in plan.split("ReadSchema:")[-1]


def test_unreadable_leaf_is_named_and_left_out(spark):
    root = os.path.join(new_dir(), "c")
    rows = C.classify(inputs.corpus(spark, SF001))
    classified.write_classified(rows, root)
    leaf = os.path.join(root, "source=src1", f"bucket={C.HIGH_BUCKET}")
    with open(os.path.join(leaf, "a-broken.parquet"), "wb") as f:  # sorts first
        f.write(b"not a parquet file")
    skipped = []
    got = classified.read_bucket(spark, root, C.HIGH_BUCKET, skipped=skipped)
    high = rows.where(F.col("bucket") == C.HIGH_BUCKET)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in high.where("source <> 'src1'").collect())
    assert len(skipped) == 1 and skipped[0][0].endswith(f"source=src1/bucket={C.HIGH_BUCKET}") and skipped[0][1]
    with pytest.raises(ValueError, match="src1"):
        classified.read_bucket(spark, root, C.HIGH_BUCKET, strict=True)


def test_size_report_keeps_source_names(spark):
    root = os.path.join(new_dir(), "c")
    df = spark.createDataFrame([("007", 0.9, "t"), ("7", 0.9, "uu"), (None, 0.9, "v"), ("a b+c%/d", 0.9, "w")],
                               "source string, score double, text string")
    classified.write_classified(C.classify(df), root)
    rep = {r.source: r.line for r in files.size_report(spark, root, C.HIGH_BUCKET).collect()}
    assert set(rep) == {"007", "7", None, "a b+c%/d"}
    assert "None" in rep[None] and "007" in rep["007"]


def test_block_sets_keep_every_column(spark):
    parent = new_dir()
    blk = B.build_blocks(inputs.table(spark, SF001, "documents"), "text", 64, 32, 8)
    blocksets.write_blocks(blk, os.path.join(parent, "a"))
    blocksets.write_blocks(blk.withColumn("lang", F.lit("en")), os.path.join(parent, "b"))
    got = blocksets.read_block_sets(spark, parent)
    n = blk.count()
    assert got.count() == 2 * n and got.where("lang IS NULL").count() == n
    blocksets.write_blocks(blk.withColumn("doc_id", F.col("doc_id").cast("string")), os.path.join(parent, "c"))
    with pytest.raises(ValueError, match="doc_id"):
        blocksets.read_block_sets(spark, parent)


def test_write_classified_returns_the_new_leaves(spark):
    root = os.path.join(new_dir(), "c")
    df = spark.createDataFrame([("a", 0.9, "t"), ("b", 0.9, "u")], "source string, score double, text string")
    assert classified.write_classified(C.classify(df.where("source = 'a'")), root) == [("a", C.HIGH_BUCKET)]
    assert classified.write_classified(C.classify(df), root) == [("b", C.HIGH_BUCKET)]
    assert classified.write_classified(C.classify(df), root) == []


def test_band_read_lists_only_the_band(spark):
    root = os.path.join(new_dir(), "c")
    classified.write_classified(C.classify(inputs.corpus(spark, SF001)), root)
    df = classified.read_bucket(spark, root, C.HIGH_BUCKET)
    listed = df.inputFiles()
    assert listed and all(f"bucket={C.HIGH_BUCKET}" in f for f in listed)
    assert classified.read_bucket(spark, root, "score_0.1_to_0.2").count() == 0
    assert files.size_report(spark, root, "score_0.1_to_0.2").count() == 0


def test_write_without_rebalance(spark):
    root = os.path.join(new_dir(), "c")
    rows = C.classify(inputs.corpus(spark, SF001))
    classified.write_classified(rows, root, rebalance=False)
    assert classified.read_classified(spark, root).count() == rows.count()


def test_block_set_with_broken_file_is_skipped(spark):
    parent = new_dir()
    blk = B.build_blocks(inputs.table(spark, SF001, "documents"), "text", 64, 32, 8)
    blocksets.write_blocks(blk, os.path.join(parent, "good"))
    bad = os.path.join(parent, "broken")
    os.makedirs(bad)
    with open(os.path.join(bad, "part-0.parquet"), "wb") as f:
        f.write(b"PAR1 not really")
    assert blocksets.read_block_sets(spark, parent).count() == blk.count()


def test_odd_partition_values_round_trip(spark):
    root = os.path.join(new_dir(), "c")
    df = spark.createDataFrame([("a/b=c%d", 0.9, "t"), (None, 0.9, "u"), ("plain", 0.65, "v")],
                               "source string, score double, text string")
    classified.write_classified(C.classify(df), root)
    assert sorted(classified.existing_leaves(spark, root), key=str) == sorted(
        [("a/b=c%d", C.HIGH_BUCKET), (None, C.HIGH_BUCKET), ("plain", "score_0.6_to_0.75")], key=str)
    classified.write_classified(C.classify(df), root, on_existing="skip")  # nothing new
    assert classified.read_classified(spark, root).count() == 3
    got = sorted((r.source or "") for r in classified.read_bucket(spark, root, C.HIGH_BUCKET).collect())
    assert got == ["", "a/b=c%d"]


def test_overwrite_replaces_only_present_leaves_and_error_mode(spark):
    root = os.path.join(new_dir(), "c")
    df = spark.createDataFrame([("a", 0.9, "t1"), ("b", 0.9, "t2"), ("b", 0.65, "t3")],
                               "source string, score double, text string")
    classified.write_classified(C.classify(df), root)
    newer = spark.createDataFrame([("a", 0.95, "t9")], "source string, score double, text string")
    classified.write_classified(C.classify(newer), root, on_existing="overwrite")
    got = sorted((r.source, r.bucket, r.text) for r in classified.read_classified(spark, root).collect())
    assert got == [("a", C.HIGH_BUCKET, "t9"), ("b", "score_0.6_to_0.75", "t3"), ("b", C.HIGH_BUCKET, "t2")]
    with pytest.raises(Exception):
        classified.write_classified(C.classify(newer), root, on_existing="error")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tokenmill.session import ensure_checkpoint_dir
    made = []
    def session(master, configured=None):
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append,
                             getConf=lambda: {"spark.checkpoint.dir": configured} if configured else {})
        return SimpleNamespace(sparkContext=sc)
    with pytest.raises(ValueError, match="checkpoint"):
        ensure_checkpoint_dir(session("yarn"))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session("local-cluster[2,1,1024]"))
    assert ensure_checkpoint_dir(session("yarn", "hdfs://shared")) == "hdfs://shared"
    made.clear()
    assert ensure_checkpoint_dir(session("local[4]"))


def test_a_band_read_keeps_every_column_and_refuses_two_types(spark):
    root = os.path.join(new_dir(), "c")
    one = spark.createDataFrame([("t", 1, "a", C.HIGH_BUCKET)], "text string, x int, source string, bucket string")
    classified.write_classified(one, root)
    two = spark.createDataFrame([("u", 2, 0.5, "b", C.HIGH_BUCKET)], "text string, x int, extra double, source string, bucket string")
    classified.write_classified(two, root)
    got = classified.read_bucket(spark, root, C.HIGH_BUCKET)
    assert set(got.columns) == {"text", "x", "extra", "source", "bucket"}
    assert {(r.text, r.extra) for r in got.collect()} == {("t", None), ("u", 0.5)}
    assert {(r.text, r.extra) for r in classified.read_classified(spark, root).collect()} == {("t", None), ("u", 0.5)}
    three = spark.createDataFrame([("v", "3", "c", C.HIGH_BUCKET)], "text string, x string, source string, bucket string")
    classified.write_classified(three, root)
    with pytest.raises(ValueError, match="column x"):
        classified.read_bucket(spark, root, C.HIGH_BUCKET)


@pytest.mark.parametrize("tasks", [True, False])
def test_a_set_with_a_damaged_later_file_is_skipped(spark, tasks, monkeypatch):
    from tokenmill.sources import probe
    if not tasks:  # a store that only Spark's readers open
        monkeypatch.setattr(probe, "tasks_can_open", lambda *a: False)
    parent, bad_table = new_dir(), os.path.join(new_dir(), "bad")
    blk = B.build_blocks(inputs.table(spark, SF001, "documents"), "text", 64, 32, 8)
    for name in ("a", "b"):
        blocksets.write_blocks(blk, os.path.join(parent, name))
    with open(os.path.join(parent, "b", "zz.parquet"), "wb") as f:
        f.write(b"PAR1 junk")
    os.makedirs(os.path.join(parent, "none"))
    skipped = []
    got = blocksets.read_block_sets(spark, parent, skipped=skipped, quarantine=bad_table)
    assert got.count() == blk.count()
    why = {os.path.basename(p): r for p, r in skipped}
    assert set(why) == {"b", "none"} and "zz.parquet" in why["b"]
    if tasks:
        table = spark.read.parquet(bad_table).collect()
        assert [(os.path.basename(r.path), r.length) for r in table] == [("zz.parquet", 9)] and table[0].error


def test_one_probe_for_a_thousand_leaves(spark):
    from tokenmill.sources import probe
    root = os.path.join(new_dir(), "many")
    rows = spark.range(2000).select((F.col("id") % 1000).alias("leaf"), "id")
    rows.repartition(4, "leaf").write.partitionBy("leaf").parquet(root)
    dirs = fs.glob_dirs(spark, root + "/leaf=*")
    probe.tasks_can_open(spark, dirs[0])
    sc = spark.sparkContext
    sc.setJobGroup("probe-1000", "")
    found = probe.probe(spark, dirs)
    jobs = len(sc.statusTracker().getJobIdsForGroup("probe-1000"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 5, jobs  # a job per stage of two small queries, whatever the number of leaves
    assert [p.path for p in found] == dirs and all(p.rows == 2 and not p.error for p in found)
    assert len({id(s) for p in found for s in p.schemas}) == 1
    assert probe.merged_schema(found).simpleString() == "struct<id:bigint>"


def test_files_are_listed_by_tasks(spark, monkeypatch):
    root = new_dir()
    for path, size in (("x/y/one.bin", 5), ("x/two.bin", 0), ("three.bin", 7), ("_hidden/four.bin", 1), ("x/.five", 1)):
        os.makedirs(os.path.join(root, os.path.dirname(path)), exist_ok=True)
        with open(os.path.join(root, path), "wb") as f:
            f.write(b"x" * size)
    want = {("one.bin", 5), ("two.bin", 0), ("three.bin", 7)}
    assert {(os.path.basename(r.path), r.length) for r in files.file_sizes(spark, root).collect()} == want
    assert "binaryFile" not in physical_plan(files.file_sizes(spark, root))
    empty = new_dir()
    assert files.file_sizes(spark, empty).count() == 0


def test_counted_write_and_leaf_rows(spark):
    root = os.path.join(new_dir(), "c")
    rows = C.classify(inputs.corpus(spark, SF001), keep_unbinned=True)
    added, seen = classified.write_counted(rows, root)
    assert seen == {"rows": rows.count(), "in_no_band": rows.where("bucket IS NULL").count()}
    again = {(r.source, r.bucket): r.n_rows for r in classified.count_rows(classified.read_classified(spark, root), "source", "bucket").collect()}
    leaves = classified.leaf_rows(spark, root).collect()
    assert {(r.source, r.bucket): r.n_rows for r in leaves} == again and set(again) == set(added)
    assert sum(r.bytes for r in leaves) == sum(r.length for r in files.file_sizes(spark, root).collect())
    assert classified.leaf_rows(spark, os.path.join(root, "nothing")).count() == 0


def test_samples_by_index(spark):
    path = os.path.join(new_dir(), "indexed")
    blk = B.build_blocks(inputs.table(spark, SF001, "documents"), "text", 64, 32, 8)
    n = blocksets.write_indexed(blk, path, ["doc_id", "chunk_idx"], rows_per_slice=50)
    rows = [(list(r.input_ids), list(r.attention_mask)) for r in blk.orderBy("doc_id", "chunk_idx").collect()]
    assert n == len(rows) and blocksets.index_size(spark, path) == (n, 50)
    asked = [0, 49, 50, n - 1, -1, -n, 7, 7, 7]
    got = sorted((r.pos, list(r.input_ids), list(r.attention_mask)) for r in blocksets.sample_at(spark, path, asked).collect())
    assert got == sorted((p % n, *rows[p]) for p in asked)
    frame = spark.createDataFrame([(p,) for p in asked], "p long")
    assert sorted((r.pos, list(r.input_ids), list(r.attention_mask)) for r in blocksets.sample_at(spark, path, frame).collect()) == got
    one = blocksets.sample_at(spark, path, [n - 1], pad_id=0).first()
    assert one.labels == [-100 if t == 0 else t for t in rows[-1][0]]
    assert blocksets.sample_at(spark, path, []).count() == 0
    with pytest.raises(IndexError):
        blocksets.sample_at(spark, path, [n])
    with pytest.raises(Exception, match="no sample"):
        blocksets.sample_at(spark, path, spark.createDataFrame([(n,)], "p long")).collect()


def test_sample_by_index_prunes_folders_and_pushes_the_position(spark):
    path = os.path.join(new_dir(), "indexed")
    blk = B.build_blocks(inputs.table(spark, SF001, "documents"), "text", 64, 32, 8)
    blocksets.write_indexed(blk, path, ["doc_id", "chunk_idx"], rows_per_slice=50)
    df = blocksets.sample_at(spark, path, [3, 120])
    plan = physical_plan(df)
    assert "PartitionFilters: [slice" in plan and "EqualTo(pos,3)" in plan and "EqualTo(pos,120)" in plan
    assert len({os.path.dirname(f) for f in df.inputFiles()}) > 2  # all folders are known ..
    read = {r.f for r in df.select(F.input_file_name().alias("f")).collect()}
    assert {os.path.basename(os.path.dirname(f)) for f in read} == {"slice=0", "slice=2"}  # .. and two are read
