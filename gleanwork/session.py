"""Session settings the jobs rely on, and where they may keep intermediate data."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Every timestamp in the model is UTC.
    "spark.sql.session.timeZone": "UTC",
    # Skewed joins are split and small partitions merged at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Longer methods are never compiled by the JVM: a stage that would have one is generated
    # operator by operator, its expressions split over methods.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # A repeated JSON key keeps its last value instead of voiding the document.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A table already hashed by bucket joins on (bucket, url) without a new shuffle.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A body with a broken byte sequence decodes with replacement, it never fails a task.
    "spark.sql.legacy.codingErrorAction": "true",
    # Python workers get bounded batches: one page or document can be megabytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # State with timers lives in RocksDB, off the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def builder(app: str = "gleanwork") -> SparkSession.Builder:
    result = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        result = result.config(key, value)
    return result


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="gleanwork-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local session without one (a test, a laptop) gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    return _local_dir()
