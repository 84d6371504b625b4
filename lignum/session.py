"""Spark session helpers.

The library itself never creates a session; these helpers are for tests, the
bench and notebooks.  On a cluster the session comes from the platform and
``spark.checkpoint.dir`` must point at shared storage; ``ensure_checkpoint_dir``
only fills it in when it is unset (local runs).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session settings the library's plans are written against.  All of them are
# plain public Spark configuration keys.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Tree tables are hash-partitioned by tree id once; joins and windows on
    # (tree_id, ...) then reuse that partitioning instead of re-shuffling.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "lignum", extra: dict | None = None) -> SparkSession:
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName(app_name)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("LIGNUM_DRIVER_MEMORY", "16g"))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in DEFAULT_CONF.items():
        if not k.startswith("spark.ui"):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint dir; make a scratch one only in local mode where none is set."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="lignum-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d
