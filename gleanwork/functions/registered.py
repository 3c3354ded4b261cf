"""The mapping functions under SQL names, for rules written as SQL expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gleanwork.functions.pay import PERIOD_WORDS
from gleanwork.functions.text import unescape


def register_functions(spark: SparkSession) -> None:
    """Make unescape, markdown, hundredths and pay_period callable in this session's SQL."""
    from gleanwork.operators.html import markdown

    spark.udf.register("unescape", unescape)
    spark.udf.register("markdown", markdown)
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION hundredths(value VARIANT) RETURNS DOUBLE
        RETURN CASE WHEN schema_of_variant(value) RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)'
        THEN try_variant_get(value, '$', 'double') / 100 END"""
    )
    named = ", ".join(
        rf"CASE WHEN lower(text) RLIKE r'(?U)\b({words})\b' THEN '{period}' END" for period, words in PERIOD_WORDS.items()
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION pay_period(text STRING) RETURNS STRING
        RETURN CASE WHEN size(array_compact(array({named}))) = 1 THEN array_compact(array({named}))[0] END"""
    )
