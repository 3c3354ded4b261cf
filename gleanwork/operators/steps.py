"""Intermediate results that later steps read more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.session import shared_dir

#: monotonically_increasing_id holds the partition above these bits.
PLACE_BITS = 33


def written(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there.

    That cuts the lineage, so a lost executor costs its own tasks only, and fixes what a
    rerun could give anew (row numbers, an order among equals).
    """
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_runs(rows: DataFrame, order: list[str], run_rows: int, name: str) -> DataFrame:
    """The rows, written in a global order, with the number of their run of at most
    `run_rows` neighbours. Runs are numbered along the order.

    A range sort gives every task a like share of the rows, whatever value is frequent, as
    long as `order` tells rows apart.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    inside = F.col(name).bitwiseAND((1 << PLACE_BITS) - 1)
    # A partition of 2**33 rows has no more runs than that, so numbers stay apart.
    run = F.shiftright(name, PLACE_BITS) * F.lit(1 << PLACE_BITS) + (inside / run_rows).cast("bigint")
    return written(placed.withColumn(name, run))
