"""Snapshot comparisons over `nation`, `region`, `part` and `lineitem`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.operators import snapshot as S
from gleanwork.operators.joins import pinned
from gleanwork.queries.mapping import mapped_responses
from gleanwork.queries.registry import query, table


def links(spark, sf, brand_rule):
    p = table(spark, sf, "part")
    url = F.concat(F.lit("https://jobs.example.com/"), F.when(brand_rule, F.lit("x/")).otherwise(F.lit("")), F.col("p_partkey").cast("string"))
    return p.select(F.col("p_brand").alias("page"), url.alias("url"))


@query(
    "snapshot_links",
    """WITH e AS (SELECT p_brand AS page, 'https://jobs.example.com/' || p_partkey AS url FROM part),
    a AS (SELECT p_brand AS page, 'https://jobs.example.com/' || CASE WHEN p_size > 45 THEN 'x/' ELSE '' END || p_partkey AS url FROM part)
    SELECT page, url, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM a)
    UNION ALL SELECT page, url, 'extra' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)""",
)
def snapshot_links(spark, sf):
    return S.link_differences(links(spark, sf, F.lit(False)), links(spark, sf, F.col("p_size") > 45), ["page", "url"])


@query("snapshot_unpinned", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def snapshot_unpinned(spark, sf):
    held = table(spark, sf, "supplier").filter(F.col("s_acctbal") > 8000).select(F.col("s_nationkey").alias("n_nationkey"))
    nations = table(spark, sf, "nation")
    return S.unpinned_links(nations, held, "n_nationkey").join(nations, "n_nationkey").select("n_name")


def snapshots(spark, sf):
    """Parts as pinned and as produced documents, altered where their size says so."""
    p = table(spark, sf, "part", spread=True)
    size = F.col("p_size")

    def doc(title, locations, description, money, meta):
        body = F.struct(
            title.alias("title"), F.col("p_brand").alias("company_name"), F.lit(None).cast("string").alias("employment_type"),
            locations.alias("locations"), description.alias("description"), money.alias("pay"), meta.alias("metadata"),
        )
        return F.try_parse_json(F.to_json(body))

    words = F.split("p_name", " ")
    money = F.struct(F.col("p_retailprice").alias("min"), F.lit(None).cast("double").alias("max"), F.lit("EUR").alias("currency"), F.lit("year").alias("period"))
    money = F.to_json(money, {"ignoreNullFields": "false"})
    none = F.lit(None)
    good = F.lit("A part.")
    expected = doc(
        F.col("p_name"), words, F.when(size == 3, F.lit("  ")).otherwise(good),
        F.when(size > 30, F.try_parse_json(money)), none.cast("map<string,string>"),
    )
    actual = doc(
        F.when(size == 1, none.cast("string")).when(size == 2, F.lit("Other")).otherwise(F.col("p_name")),
        F.when(size == 4, F.array(F.lit("elsewhere"))).otherwise(F.reverse(words)),
        F.when(size == 5, F.lit("A part")).otherwise(F.lit(" A part.\n")),
        F.when(size == 31, F.try_parse_json(F.lit('{"min":1}'))).when(size > 30, F.try_parse_json(money)),
        F.create_map(F.when(size == 6, F.lit("Bad Key")).otherwise(F.lit("ok")), F.lit("v")),
    )
    key = F.col("p_partkey")
    return p.select(key, expected.alias("doc")), p.filter(size != 7).select(key, actual.alias("doc"))


@query(
    "snapshot_fields",
    """SELECT p_partkey, f AS field, p AS problem FROM part, LATERAL (VALUES
    ('title', CASE WHEN p_size = 1 THEN 'absent' END), ('title', CASE WHEN p_size IN (1, 2) THEN 'differs' END), ('*', CASE WHEN p_size = 3 THEN 'proves_nothing' END),
    ('locations', CASE WHEN p_size = 4 THEN 'differs' END), ('description', CASE WHEN p_size = 5 THEN 'differs' END),
    ('metadata', CASE WHEN p_size = 6 THEN 'invalid' END), ('*', CASE WHEN p_size = 7 THEN 'not_produced' END),
    ('pay', CASE WHEN p_size = 31 THEN 'differs' END), ('pay', CASE WHEN p_size = 31 THEN 'invalid' END)) AS t(f, p) WHERE p IS NOT NULL""",
)
def snapshot_fields(spark, sf):
    expected, actual = snapshots(spark, sf)
    return S.field_differences(expected, actual, "p_partkey").select("p_partkey", "field", "problem")


@query(
    "foreign_documents",
    "SELECT l_orderkey AS response_id, l_partkey AS part FROM lineitem WHERE l_returnflag = 'R'",
)
def foreign_documents(spark, sf):
    """References of which those with one flag were altered after the fact."""
    text = lambda r: F.replace(F.to_json(r["document"]), F.lit('"flag":"R"'), F.lit('"flag":"X"'))
    altered = F.transform("refs", lambda r: F.struct(r["position"].alias("position"), r["url"].alias("url"), F.try_parse_json(text(r)).alias("document")))
    strange = S.foreign_documents(pinned(mapped_responses(spark, sf), refs=altered))
    return strange.select("response_id", F.regexp_extract("url", r"k=(\d+)$", 1).cast("bigint").alias("part"))
