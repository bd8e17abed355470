"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings; each can be changed on a live session.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when the plan then needs one more exchange: the
    # operators aggregate right after their joins, and one task holding a third
    # of the rows costs far more than that exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Longer methods are not compiled by the JIT; without one method a stage, expressions are split.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

FINE = 200
SPLIT = "spark.sql.files.maxPartitionBytes"
PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
# Spark's default, and the sizes set here.
SPLITS = ("134217728b", "33554432b", "8388608b")


def tune(spark: SparkSession, fine: bool = False) -> SparkSession:
    """Apply the runtime settings to a session somebody else created.

    ``fine`` cuts shuffles into many parts, which adaptive execution joins again where they
    are small: what a task sorts or hashes then has a size of its own, not a share of the input.
    """
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    if fine:
        # Up to 200 parts a map task writes them without a sort of its own.
        spark.conf.set(PARTS, max(FINE, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    else:
        spark.conf.unset(PARTS)
    # Compact files hold many rows a megabyte, and a scan may sort what it reads. A session
    # that sets its own size keeps it.
    if spark.conf.get(SPLIT) in SPLITS:
        spark.conf.set(SPLIT, SPLITS[2] if fine else SPLITS[1])
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("offerlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("OFFERLENS_SCRATCH") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    )
    for name, value in RUNTIME.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Without that setting only a local master may fall back to a temporary folder:
    on a cluster such a folder exists on one machine alone.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback
