import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from tokenmill import inputs
from tokenmill.operators import blocks as B
from tokenmill.operators import classify as C
from tokenmill.operators import telemetry as TM
from tokenmill.streaming import streams


def test_stream_blocks_equal_batch(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="tokenmill-stream-"), "blocks")
    q = streams.stream_blocks(spark, SF001, out, glob="documents.parquet", length=256, stride=128, min_len=32)
    q.awaitTermination(300)
    got = spark.read.parquet(out).select("doc_id", "chunk_idx", F.array_join("input_ids", ",").alias("ids"))
    high = C.classify(inputs.corpus(spark, SF001)).where(F.col("bucket") == C.HIGH_BUCKET)
    want = B.build_blocks(high, "text", 256, 128, 32).select(
        "doc_id", "chunk_idx", F.array_join("input_ids", ",").alias("ids"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_stream_step_loss_equals_batch(spark):
    log = streams.micro_log_stream(spark, SF001, glob="events.parquet")
    out = streams.stream_step_loss(log, grad_accum=8)
    q = (out.writeStream.format("memory").queryName("step_loss_stream").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tokenmill-ckpt-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r.opt_step, round(r.loss, 6), r.micro_batches)
           for r in spark.sql("SELECT * FROM step_loss_stream").collect()}
    batch = TM.step_loss(inputs.micro_log(spark, SF001), 8)
    want = {(r.opt_step, round(r.loss, 6), r.micro_batches) for r in batch.collect()}
    assert got == want


def test_scalar_functions_accept_a_stream(spark):
    from tokenmill.functions.text import human_size, prompt_key, thousands

    def shape(df):
        return (C.classify(df, keep_unbinned=True)
                .select("doc_id", "bucket", human_size(F.octet_length("text")).alias("size"),
                        thousands(F.col("doc_id") * 1000).alias("t"), prompt_key("text").alias("k")))

    out = os.path.join(tempfile.mkdtemp(prefix="tokenmill-stream-"), "fmt")
    q = (shape(streams.corpus_stream(spark, SF001, glob="documents.parquet")).writeStream
         .format("parquet").option("checkpointLocation", tempfile.mkdtemp(prefix="tokenmill-ckpt-"))
         .trigger(availableNow=True).start(out))
    q.awaitTermination(300)
    got = sorted(spark.read.parquet(out).collect())
    assert got == sorted(shape(inputs.corpus(spark, SF001)).collect())


def test_stream_step_loss_waits_for_late_micro_batches(spark):
    """A step split over two files (triggers) is emitted once, complete; a step whose
    closing micro-batch came but one earlier batch never did is emitted on timeout."""
    import datetime as dt
    import pandas as pd
    src = tempfile.mkdtemp(prefix="tokenmill-events-")
    t = dt.datetime(2024, 1, 1)

    def write(name, rows):
        pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        spark.createDataFrame(pdf, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                   "value double, props string").coalesce(1).write.parquet(os.path.join(src, name))

    row = lambda i, minutes: (i, t + dt.timedelta(minutes=minutes), 0, "x", float(i), "{}")
    # step 0: batches 0,1 in file a, 2,3 in file b; step 1: batch 5 missing, 7 closes it; far-later step 9
    write("a", [row(0, 0), row(1, 1)])
    write("b", [row(2, 2), row(3, 3), row(4, 4), row(6, 6), row(7, 7)])
    write("c", [row(36, 600), row(37, 601), row(38, 602), row(39, 603)])
    log = inputs.micro_log_from_events(
        spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                "value double, props string")
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src))
    out = streams.stream_step_loss(log, grad_accum=4, watermark="1 hour")
    q = (out.writeStream.format("memory").queryName("late_steps").outputMode("append")
         .option("checkpointLocation", tempfile.mkdtemp(prefix="tokenmill-ckpt-"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.opt_step: (r.micro_batches, round(r.loss, 6)) for r in spark.sql("SELECT * FROM late_steps").collect()}
    assert got[0] == (4, round((0 + 1 + 2 + 3) / 4, 6))
    assert got[1] == (3, round((4 + 6 + 7) / 4, 6))
    assert got[9] == (4, round((36 + 37 + 38 + 39) / 4, 6))


def test_closed_steps_left_in_state_are_read_at_the_end(spark):
    """Step 1 lacks a micro-batch and no later event passes its watermark."""
    import datetime as dt
    import pandas as pd
    src = tempfile.mkdtemp(prefix="tokenmill-events-")
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(minutes=i), 0, "x", float(i), "{}") for i in (0, 1, 2, 3, 4, 6, 7, 8, 9)]
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(pdf, schema).coalesce(1).write.mode("overwrite").parquet(src)
    log = inputs.micro_log_from_events(spark.readStream.schema(schema).parquet(src))
    ckpt, out = tempfile.mkdtemp(prefix="tokenmill-ckpt-"), os.path.join(src + "-out")
    q = (streams.stream_step_loss(log, grad_accum=4).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out))
    streams.run_to_end(q)
    done = {r.opt_step for r in spark.read.parquet(out).collect()}
    rest = {r.opt_step: (r.micro_batches, r.loss) for r in streams.open_closed_steps(spark, ckpt).collect()}
    assert done == {0} and rest == {1: (3, (4 + 6 + 7) / 4)}  # step 2 is not closed


def test_streamed_queries_read_tables_kept_as_folders(spark):
    """The larger tables are folders of part files; other tables lie beside them."""
    from tokenmill.queries import stream_queries as Q
    root = tempfile.mkdtemp(prefix="tokenmill-folders-")
    for name in ("documents", "events"):
        spark.read.parquet(os.path.join(SF001, f"{name}.parquet")).repartition(3).write.parquet(os.path.join(root, f"{name}.parquet"))
    for query in (Q.streamed_blocks, Q.streamed_step_loss):
        got = sorted(query(spark, root).collect())
        assert got and got == sorted(query(spark, SF001).collect())


def test_streamed_blocks_of_a_table_without_rows(spark):
    from tokenmill.queries import stream_queries as Q
    root = tempfile.mkdtemp(prefix="tokenmill-empty-")
    spark.read.parquet(os.path.join(SF001, "documents.parquet")).limit(0).write.parquet(os.path.join(root, "documents.parquet"))
    assert Q.streamed_blocks(spark, root).collect() == []


def test_step_loss_keeps_a_state_row_per_span_of_steps(spark):
    """2,048 steps, of which the even ones lack a micro-batch but are closed; some of a span come later."""
    src = tempfile.mkdtemp(prefix="tokenmill-spans-")
    rows = spark.range(4 * 2 * streams.SPAN).where("id % 8 <> 1").select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 100).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("user_id"), F.lit("x").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))
    rows.where("event_id % 5 > 0").coalesce(1).write.parquet(os.path.join(src, "a"))
    rows.where("event_id % 5 = 0").coalesce(1).write.parquet(os.path.join(src, "b"))
    log = inputs.micro_log_from_events(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true")
                                       .option("maxFilesPerTrigger", 1).parquet(src))
    ckpt, out = tempfile.mkdtemp(prefix="tokenmill-ckpt-"), src + "-out"
    q = (streams.stream_step_loss(log, grad_accum=4).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start(out))
    streams.run_to_end(q)
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2
    cols = ["opt_step", "loss", "micro_batches", "start_ts", "end_ts"]
    done, rest = spark.read.parquet(out).select(*cols), streams.open_closed_steps(spark, ckpt).select(*cols)
    assert done.count() == streams.SPAN == rest.count()
    want = rows.groupBy(F.expr("event_id div 4").alias("opt_step")).agg(
        F.sum(F.col("value") / 4).alias("loss"), F.count(F.lit(1)).alias("micro_batches"),
        F.min(F.col("ts").cast("timestamp")).alias("start_ts"), F.max(F.col("ts").cast("timestamp")).alias("end_ts"))
    assert sorted(done.unionByName(rest).collect()) == sorted(want.select(*cols).collect())
