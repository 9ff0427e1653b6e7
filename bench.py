"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line. Every query is executed in full through the ``noop`` sink
(nothing is collected to the driver); one untimed warm-up pass comes first, then
each query's time is the median of $BENCH_REPEATS (default 3) runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tokenmill import inputs, registry  # noqa: E402
from tokenmill.functions.text import word_count  # noqa: E402
from tokenmill.operators import blocks as B  # noqa: E402
from tokenmill.operators import classify as C  # noqa: E402
from tokenmill.session import local_session, scratch_path  # noqa: E402
from tokenmill.sources import classified  # noqa: E402

HEADLINE = (
    "score_bucket_counts",   # F4: one-pass classification
    "classified_roundtrip",  # IO2 + IO5: partitioned write, pruned read
    "token_blocks",          # T1 + T2 + T3: tokenize and cut the high band
    "padding_report",        # G8 over the blocks of every document
    "vocab_top",             # T7: word counts + top-k
    "training_plan",         # E1-E6: 2 epochs x 4 ranks
    "step_rates",            # G4 + M5 over the micro-batch log
    "chat_render",           # T4
    "pack_bins",             # T5
    "weighted_interleave",   # U3
    "capped_samples",        # O2
    "text_bytes_report",     # G2 twin
)


def run(spark, name, sf_dir):
    t0 = time.perf_counter()
    registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def timed(action):
    t0 = time.perf_counter()
    action()
    return time.perf_counter() - t0


def throughput(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    n_docs = docs.count()
    n_words = docs.select(F.sum(word_count("text"))).first()[0]
    write_s = timed(lambda: classified.write_classified(C.classify(inputs.corpus(spark, sf_dir)),
                                                        scratch_path(spark, "bench-classified")))
    blocks = B.build_blocks(docs, "text", B.MAX_LENGTH, B.STRIDE, B.MIN_CHUNK_LENGTH)
    blocks_s = timed(lambda: blocks.write.format("noop").mode("overwrite").save())
    fast = B.build_blocks(docs, "text", B.MAX_LENGTH, B.STRIDE, B.MIN_CHUNK_LENGTH, hash="xxhash64")
    fast_s = timed(lambda: fast.write.format("noop").mode("overwrite").save())
    plan = registry.QUERIES["training_plan"](spark, sf_dir)
    plan_rows = plan.count()
    plan_s = timed(lambda: registry.QUERIES["training_plan"](spark, sf_dir)
                   .write.format("noop").mode("overwrite").save())
    return {
        "documents_per_sec_classify_write": round(n_docs / write_s, 1),
        "tokens_per_sec_tokenize_blocks_2048": round(n_words / blocks_s, 1),
        "tokens_per_sec_tokenize_blocks_2048_xxhash64": round(n_words / fast_s, 1),
        "plan_rows_per_sec": round(plan_rows / plan_s, 1),
    }


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="tokenmill-bench")
    registry.load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    for n in names:  # warm-up pass (JIT, Python workers), not timed
        run(spark, n, sf_dir)
    times = {n: round(statistics.median(run(spark, n, sf_dir) for _ in range(repeats)), 3) for n in names}

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = throughput(spark, sf_dir)
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "documents": docs,
        "throughput": rates,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
