"""Run in a subprocess by test_retry.py: the dense index and packing with a task
that fails on its first attempt (local[4,3] allows retries) must equal a clean run."""

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tokenmill.operators.chat import pack  # noqa: E402
from tokenmill.plans import sampling as S  # noqa: E402
from tokenmill.plans.index import dense_index_by_hash  # noqa: E402
from tokenmill.session import ensure_checkpoint_dir  # noqa: E402


@F.pandas_udf(T.LongType())
def flaky(ids: pd.Series) -> pd.Series:
    ctx = TaskContext.get()
    if ctx is not None and ctx.partitionId() == 1 and ctx.attemptNumber() == 0:
        mark = os.path.join(os.environ["RETRY_MARK_DIR"], f"stage-{ctx.stageId()}")
        open(mark, "w").close()
        raise RuntimeError("injected task failure")
    return ids


def results(spark, fail: bool):
    base = spark.range(0, 5000, 1, 4)
    ids = flaky(F.col("id")) if fail else F.col("id")
    df = base.select(ids.alias("doc_id"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("k", S.shuffle_key(["doc_id"], 9, 0))
    pos = dense_index_by_hash(df, "k", ["doc_id"], ["g"]).select("doc_id", "pos", "n_total")
    lens = base.select(ids.alias("conv_id"), (F.col("id") * 13 % 90 + 1).alias("length"))
    bins = pack(lens, 128, ["conv_id"], "length", n_shards=8, seed=2).select("conv_id", "bin", "bin_offset")
    return sorted(map(tuple, pos.collect())), sorted(map(tuple, bins.collect()))


if __name__ == "__main__":
    spark = (SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "4").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    ensure_checkpoint_dir(spark)
    clean = results(spark, fail=False)
    retried = results(spark, fail=True)
    failures = len(os.listdir(os.environ["RETRY_MARK_DIR"]))
    print(json.dumps({"equal": clean == retried, "rows": len(clean[0]), "bins": len(clean[1]),
                      "failed_attempts": failures}))
