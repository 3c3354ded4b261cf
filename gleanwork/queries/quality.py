"""Metadata rules, stored-data checks and upgrades."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.operators import quality as Q
from gleanwork.queries.functions import part_metadata
from gleanwork.queries.registry import query, table


@query(
    "metadata_rules",
    """SELECT p_partkey, k AS key, r AS rule FROM part, LATERAL (VALUES ('Size', 'not_snake_case'), ('deep', 'not_scalar_or_list'), ('flag', 'not_scalar_or_list'),
    ('site', CASE WHEN p_size > 40 THEN 'holds_url' ELSE 'repeats_title' END)) AS t(k, r)""",
)
def metadata_rules(spark, sf):
    found = part_metadata(spark, sf).select("p_partkey", F.explode(Q.metadata_violations(F.col("row"))).alias("f"))
    return found.select("p_partkey", "f.key", "f.rule")


def old_customers(spark, sf):
    """Customers in the layout before content types existed."""
    key = F.concat(F.lit("https://jobs.example.com/c/"), F.col("c_custkey").cast("string"))
    return table(spark, sf, "customer").select(key.alias("url"), F.col("c_name").alias("raw_html"), "c_mktsegment")


@query(
    "upgrade_table",
    """SELECT 'https://jobs.example.com/c/' || c_custkey AS url, c_name AS raw_content, c_mktsegment, 'text/html' AS content_type,
    'https://jobs.example.com/c/' || c_custkey AS source_url FROM customer""",
)
def upgrade_table(spark, sf):
    return Q.upgrade_bronze(old_customers(spark, sf))


@query(
    "upgrade_boards",
    "SELECT s_suppkey, CASE WHEN s_acctbal < 5000 THEN 'api' ELSE 'html_crawl' END AS type FROM supplier",
)
def upgrade_boards(spark, sf):
    kind = F.when(F.col("s_acctbal") < 0, "api").when(F.col("s_acctbal") < 5000, "json_api").otherwise("html_crawl")
    return Q.upgrade_boards(table(spark, sf, "supplier").select("s_suppkey", kind.alias("type")))


@query(
    "schema_drift",
    """WITH n AS (SELECT o_orderpriority AS domain, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'P') AS p,
        count(*) FILTER (o_orderstatus = 'O') AS o, count(*) AS c FROM orders GROUP BY 1)
    SELECT domain, 'price' AS "column", 'type' AS problem, 'STRING' AS declared, CASE WHEN f = c THEN 'BIGINT' ELSE 'VARIANT' END AS stored FROM n WHERE f > 0
    UNION ALL SELECT domain, 'extra', 'unexpected', NULL, 'BOOLEAN' FROM n WHERE p > 0
    UNION ALL SELECT domain, 'never', 'missing', 'ARRAY<STRING>', NULL FROM n
    UNION ALL SELECT domain, 'note', CASE WHEN o = 0 THEN 'missing' ELSE 'type' END, 'STRING', CASE WHEN o > 0 THEN 'VOID' END FROM n""",
)
def schema_drift(spark, sf):
    """Every order's document against one shape: a price that is a number for some, an extra
    member, one that is always null and one that nobody has."""
    is_f, is_p, is_o = (F.col("o_orderstatus") == s for s in "FPO")
    text = F.concat(
        F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"price":'), F.when(is_f, "7").otherwise('"7"'),
        F.when(is_p, ',"extra":true').otherwise(""), F.when(is_o, ',"note":null').otherwise(""), F.lit("}"),
    )
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("domain"), F.try_parse_json(text).alias("doc"))
    return Q.document_drift(rows, {"id": "BIGINT", "price": "STRING", "never": "ARRAY<STRING>", "note": "STRING"})


@query(
    "layout_drift",
    """SELECT * FROM (VALUES ('raw_job_postings', 'raw_content', 'missing', 'string', NULL), ('raw_job_postings', 'raw_html', 'unexpected', NULL, 'string'),
    ('raw_job_postings', 'c_mktsegment', 'type', 'int', 'string')) AS t("table", "column", problem, declared, stored)
    WHERE EXISTS (SELECT 1 FROM customer)""",
)
def layout_drift(spark, sf):
    """The columns of a stored table against its declaration."""
    declared = T.StructType(
        [T.StructField("url", T.StringType()), T.StructField("raw_content", T.StringType()), T.StructField("c_mktsegment", T.IntegerType())]
    )
    return Q.schema_drift_report("raw_job_postings", old_customers(spark, sf), declared)


@query(
    "null_violations",
    """SELECT * FROM (SELECT 'o_orderstatus' AS "column", count(*) FILTER (o_orderstatus = 'P') AS nulls FROM orders UNION ALL
    SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority = '5-LOW') FROM orders) WHERE nulls > 0""",
)
def null_violations(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("o_orderstatus"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"),
    )
    return Q.null_violations(rows, ["o_orderkey", "o_orderstatus", "o_orderpriority"])
