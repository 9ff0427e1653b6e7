"""Session helpers: a local session for tests and the bench, and the shared
scratch location every writing operator uses.

On a cluster the scratch root is the shared folder named by
``spark.checkpoint.dir``; we only pick our own folder when the session has
none (local tests), never a machine-local temp folder on a cluster.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tokenmill") -> SparkSession:
    """Session used by tests and ``bench.py``; UI off, AQE on, UTC."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir, setting a local one only if unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = sc.getConf().get(_CHECKPOINT_KEY, None)
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError(f"{_CHECKPOINT_KEY} must name a folder that all executors share (master {sc.master})")
    # Unset only in tests / local runs: a throw-away local folder is fine there.
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tokenmill-ckpt-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root.rstrip("/"), "tokenmill", f"{name}-{uuid.uuid4().hex}")
