"""Where operators keep what later steps read again."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir, which all executors share.

    Only a local session without one, as in tests, gets a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _local_folder()


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="gleanwork-llm-")


def kept(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there.

    It cuts the lineage: a lost executor costs the tasks it ran, not what led to them, and
    values that a rerun could give anew (row numbers, an order) are fixed.
    """
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Column names, made from the stems, that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        names.append(stem)
        taken.add(stem.lower())
    return names


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows but those whose number is in the one column of `gone`, with all their columns,
    whatever their names. Rows are numbered as monotonically_increasing_id does."""
    row, other = unused(docs, "row", "gone")
    at = docs.withColumn(row, F.monotonically_increasing_id())
    return at.join(gone.toDF(other), F.col(row) == F.col(other), "left_anti").drop(row)
