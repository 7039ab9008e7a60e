"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

# Session defaults for the engine. AQE re-plans joins from runtime sizes
# (small crawl levels become broadcast joins), coalesces tiny shuffle
# partitions and splits skewed ones (hot terms, hub pages).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sitesift", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; locally
    ``local[N]`` with ``shuffle_partitions`` close to N.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Read from ``spark.checkpoint.dir`` as the cluster sets it. Only when it
    is unset on a local master (local runs, tests) a private temporary folder
    is made and recorded in the session so that later calls agree; on a
    cluster an unset folder is an error, never a machine-local path.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(intermediate tables are written there)")
        root = tempfile.mkdtemp(prefix="sitesift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(root, "rdd"))
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the checkpoint root for one job."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


# Compressed input bytes per partition when a job sizes its own shuffle.
TARGET_INPUT_BYTES = 256 * 1024 * 1024
MAX_PARTITIONS = 100_000
# From this size on a leaf's statistics are Spark's default for "not known".
UNKNOWN_SIZE = 1 << 62


def partitions_for(df, target_bytes: int = TARGET_INPUT_BYTES) -> int:
    """A partition count for shuffling ``df``: one per ``target_bytes`` of the
    tables its plan reads (Catalyst's statistics of the leaves, no job; a join's own
    estimate is the product of its sides), and never fewer than the cluster's default
    parallelism. Where a leaf has no size, the session's setting."""
    spark = df.sparkSession
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    except Py4JError:        # no statistics
        sizes = [UNKNOWN_SIZE]
    if max(sizes, default=0) >= UNKNOWN_SIZE:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = sum(sizes)
    by_size = -(-size // target_bytes)
    return int(max(spark.sparkContext.defaultParallelism, min(by_size, MAX_PARTITIONS)))


def spread(df, min_partitions: int | None = None):
    """Round-robin rows over at least the cluster's parallelism when the input
    has fewer partitions (e.g. one large Parquet row group, which Spark cannot
    split), before CPU-heavy narrow work. A no-op on inputs that are already
    split finer, as any large table is."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
