"""Bronze rows that still lack a Silver row, and which of them a rule can now serve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.urls import url_host
from gleanwork.operators import rules as R
from gleanwork.operators.joins import fits, lookup_join
from gleanwork.operators.silver import is_mapped


def backfill_candidates(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Live Bronze rows never turned into Silver: not tried yet, or refused."""
    return bronze.filter(F.col("deleted_at").isNull()).join(silver.select("url"), "url", "left_anti")


def backfill_state(
    candidates: DataFrame, winners: DataFrame, kinds: tuple[str, ...] = (R.EXTRACTION,)
) -> DataFrame:
    """candidates plus `has_rule`.

    By default only page rules count, looked up by the posting's address. With the detail
    kind included, JSON rows are looked up by their feed's address.
    """
    lookup = winners.filter(F.col("kind").isin(*kinds)).select(
        F.col("domain").alias("host"), "kind", F.lit(True).alias("has_rule")
    )
    if R.DETAIL in kinds:
        mapped = is_mapped(F.col("content_type"))
        keyed = candidates.withColumn(
            "host", url_host(F.when(mapped, F.col("source_url")).otherwise(F.col("url")))
        ).withColumn("kind", F.when(mapped, F.lit(R.DETAIL)).otherwise(F.lit(R.EXTRACTION)))
    else:
        keyed = candidates.withColumn("host", url_host(F.col("url"))).withColumn("kind", F.lit(R.EXTRACTION))
    joined = lookup_join(keyed, lookup, ["host", "kind"], "left", ["url"], fits(lookup))
    return joined.withColumn("has_rule", F.coalesce("has_rule", F.lit(False))).drop("kind")


def backfill_summary(state: DataFrame) -> DataFrame:
    """matched, skipped for want of a rule, and enqueued; a dry run counts the same."""
    return state.agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(~F.col("has_rule")).alias("skipped_no_rule"),
        F.count_if("has_rule").alias("enqueued"),
    )
