"""The JSON mapping over documents made of `orders`, `lineitem` and `events`."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions.urls import url_host
from gleanwork.functions.registered import register_functions
from gleanwork.operators import filters as P
from gleanwork.operators import mapping as M
from gleanwork.operators import rules as R
from gleanwork.queries.functions import listings
from gleanwork.queries.registry import query, table
from gleanwork.sources.messages import page_items, posting_items

SHIPPED = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "rules")
FEED = "boards-api.greenhouse.io"
ACME = {
    "version": 1,
    "type": "detail",
    "domains": ["api.acme.example.com"],
    "fields": {
        "title": {"sql": "upper(try_variant_get(doc, '$.title', 'string'))"},
        "company_name": "company_name",
        "employment_type": "departments[0].name",
        "locations": "offices[].name",
        "description": {"path": "content", "apply": ["unescape"]},
        "metadata": {"object": {"order": "id", "missing": "no.such"}},
    },
}


def shipped_rules(spark):
    """The rule documents of the package, read here as files of this host."""
    import json

    rules = []
    for name in sorted(os.listdir(SHIPPED)):
        with open(os.path.join(SHIPPED, name), encoding="utf-8") as file:
            rules.append(R.parse_rule(json.load(file), None, name))
    return rules


def all_rules(spark):
    rules = [*shipped_rules(spark), R.parse_rule(ACME)]
    return rules, R.resolve_rules(R.rules_table(spark, rules))[0]


def order_documents(spark, sf, broken: bool = False):
    """One JSON posting per order on three feeds, one of them unknown.

    With `broken`, the order's price decides whether and how its row is spoiled.
    """
    o = table(spark, sf, "orders", spread=True)
    price = F.col("o_totalprice")
    spoil = F.lit(broken)
    year = F.concat(F.lit("Year "), F.year("o_orderdate").cast("string"))

    def office(name):
        return F.struct(F.col("o_custkey").alias("id"), name.alias("name"))

    names = F.array(office(year), office(F.lit(None).cast("string")), office(F.lit("Zürich")))
    doc = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("id"),
            F.col("o_orderpriority").alias("title"),
            F.when(spoil & price.between(60000, 80000), F.lit("")).otherwise(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))).alias("company_name"),
            F.when(~(spoil & price.between(100000, 120000)), names).alias("offices"),
            F.array(F.struct(F.col("o_orderstatus").alias("name"))).alias("departments"),
            F.array(F.struct(F.lit("Other").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("Location Type").alias("name"), F.lit("On-Site").alias("value"))).alias("metadata"),
            F.array(
                F.struct(
                    F.round(price * 100).cast("bigint").alias("min_cents"), F.round(price * 200).cast("bigint").alias("max_cents"),
                    F.lit("EUR").alias("currency_type"), F.lit("Annual Salary:").alias("title"),
                )
            ).alias("pay_input_ranges"),
            F.when(~(spoil & price.between(80000, 100000)), F.concat(F.lit("&lt;h3&gt;Role&lt;/h3&gt;&lt;p&gt;Order &lt;b&gt;"), "o_orderpriority", F.lit("&lt;/b&gt; &amp;amp; more&lt;/p&gt;"))).alias("content"),
        )
    )
    body = (
        F.when(spoil & (price < 20000), F.substring(doc, 1, 40))
        .when(spoil & (price < 30000), F.lit("5"))
        .when(spoil & (price < 40000), F.lit('"text"'))
        .when(spoil & price.between(120000, 140000), F.replace(doc, F.lit('"content":"'), F.lit('"content":[1],"was":"')))
        .when(spoil & price.between(140000, 160000), F.replace(doc, F.lit('"Zürich"'), F.lit("7")))
        .otherwise(doc)
    )
    feed = (
        F.when(F.col("o_orderstatus") == "O", F.lit(f"https://{FEED}/v1/jobs?content=true"))
        .when(F.col("o_orderstatus") == "F", F.lit("https://API.acme.example.com:8443/feed"))
        .otherwise(F.concat(F.lit("https://nowhere"), (F.col("o_custkey") % 5).cast("string"), F.lit(".example.com/feed")))
    )
    return o.select(
        F.concat(F.lit("https://jobs.example.com/p/"), F.col("o_orderkey").cast("string")).alias("url"),
        body.alias("raw_content"),
        F.lit("application/json").alias("content_type"),
        feed.alias("source_url"),
        F.lit(None).cast("string").alias("start_url_id"),
    )


@query(
    "json_detail_map",
    """SELECT 'https://jobs.example.com/p/' || o_orderkey AS url, o_orderpriority AS title, 'Customer ' || o_custkey AS company_name,
    CASE WHEN o_orderstatus = 'F' THEN 'F' END AS employment_type, '["Year ' || year(o_orderdate) || '","Zürich"]' AS locations,
    CASE WHEN o_orderstatus = 'O' THEN '["O"]' END AS categories,
    CASE WHEN o_orderstatus = 'O' THEN '# Role' || chr(10) || chr(10) || 'Order **' || o_orderpriority || '** & more'
         ELSE '<h3>Role</h3><p>Order <b>' || o_orderpriority || '</b> &amp; more</p>' END AS description,
    CASE WHEN o_orderstatus = 'O' THEN '{"location_type":"On-Site"}' ELSE '{"missing":null,"order":' || o_orderkey || '}' END AS metadata,
    CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice, 2) END AS low, CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 2, 2) END AS high,
    CASE WHEN o_orderstatus = 'O' THEN 'year' END AS period FROM orders WHERE o_orderstatus IN ('O', 'F')
    UNION ALL SELECT 'https://jobs.example.com/p/' || o_orderkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""",
)
def json_detail_map(spark, sf):
    rules, winners = all_rules(spark)
    docs = order_documents(spark, sf).withColumn("doc", D.parse_document(F.col("raw_content")))
    attached = M.attach_rule(docs, winners, R.DETAIL, F.col("source_url"), ["url"])
    mapped = M.map_detail(attached, rules)
    texts = [D.as_string(F.col(f"mapped.{f}")).alias(f) for f in ("title", "company_name", "employment_type", "description")]
    trees = [F.to_json(F.col(f"mapped.{f}")).alias(f) for f in ("locations", "categories", "metadata")]
    pay = F.col("mapped.pay")
    return mapped.select(
        "url", *texts, *trees,
        F.try_variant_get(pay, "$.min", "double").alias("low"), F.try_variant_get(pay, "$.max", "double").alias("high"),
        F.try_variant_get(pay, "$.period", "string").alias("period"),
    )


MANY = 300


@query(
    "json_many_rules",
    f"SELECT o_orderkey AS order_id, CASE WHEN o_custkey % 350 < {MANY} THEN o_orderpriority END AS title FROM orders",
)
def json_many_rules(spark, sf):
    """A rule of its own for each of 300 customers' documents; a seventh have no such rule."""
    many = [
        R.parse_rule({"version": 1, "type": R.DETAIL, "domains": [f"c{i}.example.com"], "fields": {"title": f"t{i}"}})
        for i in range(MANY)
    ]
    place = (F.col("o_custkey") % 350).cast("int")
    text = F.concat(F.lit('{"t'), place.cast("string"), F.lit('":"'), F.col("o_orderpriority"), F.lit('"}'))
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), place.alias("rule_id"), D.parse_document(text).alias("doc")
    )
    return M.map_detail(docs, many).select("order_id", D.as_string(F.col("mapped.title")).alias("title"))


@query("json_blank_bodies", "SELECT c_custkey AS id, c_custkey AS member FROM customer")
def json_blank_bodies(spark, sf):
    """Bodies with thousands of blanks before their document."""
    key = F.col("c_custkey")
    body = F.concat(F.repeat(F.lit(" "), (key % 7 + 5000).cast("int")), F.lit('{"k":'), key.cast("string"), F.lit("}"))
    return table(spark, sf, "customer").select(
        key.alias("id"), F.try_variant_get(D.parse_document(body), "$.k", "bigint").alias("member")
    )


def responses(spark, sf):
    lists = listings(spark, sf)
    key = F.col("l_orderkey").cast("string")
    return lists.select(
        F.col("l_orderkey").alias("response_id"),
        F.concat(F.lit(f"https://{FEED}/v1/b"), key, F.lit("/jobs?content=true")).alias("response_url"),
        key.alias("start_url_id"),
        F.try_parse_json(F.to_json(F.struct("jobs"))).alias("doc"),
    )


def references(spark, sf):
    rules, winners = all_rules(spark)
    attached = M.attach_rule(responses(spark, sf), winners, R.INDEX, F.col("response_url"), ["response_id"])
    return M.map_index(attached, rules)


def mapped_responses(spark, sf):
    """The responses with their references in a row, beside the whole document."""
    rules, winners = all_rules(spark)
    attached = M.attach_rule(responses(spark, sf), winners, R.INDEX, F.col("response_url"), ["response_id"])
    return M.index_refs(attached.withColumn("whole", F.col("doc")), rules).withColumnRenamed("whole", "doc")


def filtered(spark, sf):
    rules, winners = all_rules(spark)
    given = responses(spark, sf).join(board_addresses(spark, sf), "response_id")
    attached = M.attach_rule(given, winners, R.INDEX, F.col("response_url"), ["response_id"])
    return P.apply_posting_filters(M.index_refs(attached, rules))


@query(
    "json_index_explode",
    f"""SELECT l_orderkey AS response_id, 'https://{FEED}/v1/p/' || l_linenumber || '?k=' || l_partkey AS url, l_partkey AS part FROM lineitem""",
)
def json_index_explode(spark, sf):
    part = F.try_variant_get("document", "$.part", "bigint").alias("part")
    return references(spark, sf).select("response_id", "url", part)


@query(
    "posting_items",
    f"""SELECT l_orderkey AS response_id, 'https://{FEED}/v1/p/' || l_linenumber || '?k=' || l_partkey AS url, 'application/json' AS content_type,
    'https://{FEED}/v1/b' || l_orderkey || '/jobs?content=true' AS source_url, CAST(l_orderkey AS VARCHAR) AS start_url_id, 'google' AS spider,
    l_partkey AS part FROM lineitem""",
)
def item_envelopes(spark, sf):
    """Every posting in hand as the item a crawl emits for it."""
    items = posting_items(references(spark, sf), "google").select("item.*")
    return items.select(
        F.try_variant_get("start_url_id", "$", "bigint").alias("response_id"), "url", "content_type", "source_url",
        F.try_variant_get("start_url_id", "$", "string").alias("start_url_id"),
        F.try_variant_get("metadata", "$.spider_name", "string").alias("spider"),
        F.try_variant_get(F.try_parse_json("raw_content"), "$.part", "bigint").alias("part"),
    )


@query(
    "page_items",
    "SELECT url, html AS raw_content, url AS source_url, CASE WHEN url LIKE 'https:%' THEN 'text/html' ELSE 'application/xhtml+xml' END AS content_type FROM pages",
)
def page_envelopes(spark, sf):
    """Every fetched page as an item, its media type bare."""
    header = F.when(~F.startswith("url", F.lit("https:")), F.lit("Application/XHTML+xml; charset=utf-8"))
    items = page_items(table(spark, sf, "pages").withColumn("content_type", header), "google")
    return items.select("item.url", "item.raw_content", "item.source_url", "item.content_type")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'k' AS path, true AS resolved FROM events")
def json_props(spark, sf):
    found = D.eval_path(D.parse_document(F.col("props")), F.lit("k"))
    props = table(spark, sf, "events").select("event_id", found.alias("found"))
    value = F.try_variant_get(F.get("found.items", F.lit(0)), "$", "bigint")
    return props.select("event_id", value.alias("k"), F.lit("k").alias("path"), "found.resolved")


def board_addresses(spark, sf):
    """Each order's board address: the filters it carries depend on the order."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("k"))
    query_part = (
        F.when(F.col("k") % 7 == 0, F.lit("filter.flag=A&filter.flag=N&per=5"))
        .when(F.col("k") % 7 == 1, F.lit("filter.offices[].name=O&filter.flag=R"))
        .when(F.col("k") % 7 == 2, F.lit("filter.remote=false"))
        .when(F.col("k") % 7 == 3, F.lit("filter.ofices[].name=O"))
        .when(F.col("k") % 7 == 4, F.lit("filter.no_such(flag)=x"))
        .when(F.col("k") % 7 == 5, F.concat(F.lit("filter.part="), F.col("k").cast("string")))
        .otherwise(F.lit("per=5"))
    )
    return lists.select(
        F.col("l_orderkey").alias("response_id"), F.concat(F.lit("https://x.example.com/jobs?"), query_part).alias("stored_url")
    )


FILTERED = f"""
b AS (SELECT l_orderkey, max(l_partkey) AS k, count(*) FILTER (l_tax > 0.02) AS officed FROM lineitem GROUP BY 1),
j AS (SELECT l.*, b.k, b.officed, 'https://{FEED}/v1/p/' || l_linenumber || '?k=' || l_partkey AS url,
      CASE k % 7 WHEN 0 THEN l_returnflag IN ('A', 'N') WHEN 1 THEN l_returnflag = 'R' AND l_tax > 0.02 AND l_linestatus = 'O'
        WHEN 2 THEN l_linestatus <> 'O' WHEN 5 THEN l_partkey = k ELSE true END AS matched,
      CASE k % 7 WHEN 3 THEN 'unresolved_key' WHEN 4 THEN 'invalid_key' WHEN 1 THEN CASE WHEN officed = 0 THEN 'unresolved_key' END END AS reason
      FROM lineitem AS l JOIN b ON b.l_orderkey = l.l_orderkey)"""


@query("posting_filters", f"WITH {FILTERED} SELECT l_orderkey AS response_id, url FROM j WHERE matched AND reason IS NULL")
def posting_filters(spark, sf):
    return filtered(spark, sf)[0].select("response_id", "url")


@query("posting_filter_refusals", f"WITH {FILTERED} SELECT DISTINCT l_orderkey AS response_id, reason FROM j WHERE reason IS NOT NULL")
def posting_filter_refusals(spark, sf):
    return filtered(spark, sf)[1]


@query("filter_text", "SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END WHEN 'R' THEN CAST(l_partkey AS VARCHAR) END AS text FROM lineitem")
def filter_text(spark, sf):
    value = (
        F.when(F.col("l_returnflag") == "A", F.lit('"A"'))
        .when(F.col("l_returnflag") == "N", (F.col("l_linestatus") == "O").cast("string"))
        .otherwise(F.col("l_partkey").cast("string"))
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", D.filter_text(F.try_parse_json(value)).alias("text")
    )


def supplier_rules(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(
        F.when(F.col("s_acctbal") > 5000, "index").otherwise("detail").alias("kind"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".example.com")).alias("domain"),
        F.col("s_suppkey").cast("int").alias("load_order"),
        F.col("s_suppkey").cast("int").alias("rule_id"),
    )


SUPPLIED = """r AS (SELECT CASE WHEN s_acctbal > 5000 THEN 'index' ELSE 'detail' END AS kind, 'n' || s_nationkey || '.example.com' AS domain, s_suppkey FROM supplier)"""


@query("resolve_rules", f"WITH {SUPPLIED} SELECT kind, domain, max(s_suppkey) AS rule_id FROM r GROUP BY kind, domain")
def resolve_rules(spark, sf):
    return R.resolve_rules(supplier_rules(spark, sf))[0]


@query(
    "rule_collisions",
    f"WITH {SUPPLIED} SELECT kind, domain, count(*) AS claims, max(s_suppkey) AS rule_id FROM r GROUP BY kind, domain HAVING count(*) > 1",
)
def rule_collisions(spark, sf):
    return R.resolve_rules(supplier_rules(spark, sf))[1]


@query(
    "route_rules",
    """WITH h AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, page_id FROM pages),
    r AS (SELECT host, max(page_id) AS rule_id FROM h WHERE host LIKE '%.com' GROUP BY host)
    SELECT page_id, h.host, rule_id FROM h LEFT JOIN r ON r.host = h.host""",
)
def route_rules(spark, sf):
    """Every page with the newest rule of its host; hosts outside .com have none."""
    pages = table(spark, sf, "pages")
    host = url_host(F.col("url"))
    claims = pages.select(
        F.lit("extraction").alias("kind"), host.alias("domain"),
        F.col("page_id").cast("int").alias("load_order"), F.col("page_id").alias("rule_id"),
    ).filter(F.endswith("domain", F.lit(".com")))
    winners, _ = R.resolve_rules(claims)
    return M.attach_rule(pages, winners, R.EXTRACTION, F.col("url"), ["page_id"]).select("page_id", "host", "rule_id")


# What is wrong with the rule document of a part, by its size, and why it is refused.
SPOILED = (
    ('{"version":', "not JSON"),
    ('["version"]', "not an object"),
    ('{"version":1,"type":"detail","domains":["d"],"fields":{"title":"t"},"author":"me","b":1}', "keys that no rule has: ['author', 'b']"),
    ('{"version":2,"type":"detail","domains":["d"],"fields":{"title":"t"}}', "written for another version: 2"),
    ('{"version":true,"type":"detail","domains":["d"],"fields":{"title":"t"}}', "written for another version: true"),
    ('{"version":1,"type":"other","domains":["d"],"fields":{"title":"t"}}', 'no such kind of rule: "other"'),
    ('{"version":1,"type":"detail","domains":["d",3],"fields":{"title":"t"}}', "no domain is served: 'domains' lists host names"),
    ('{"version":1,"type":"detail","domains":["d"],"fields":{}}', "nothing is read: 'fields' maps names to specifications"),
    ('{"version":1,"type":"detail","domains":["d"],"fields":{"title":"t","salary":"s"}}', "fields that a detail rule cannot fill: ['salary']"),
    ('{"version":1,"type":"index","domains":["d"],"fields":{"postings":"p"}}', "fields that a index rule needs: ['posting_url']"),
    ('{"version":1,"type":"detail","domains":["d"],"fields":{"title":7}}', "not a field specification: 7"),
)


def rule_files(spark, sf):
    """A rule document for each part, spoiled in eleven ways by its size."""
    p = table(spark, sf, "part")
    even = F.col("p_size") % 2 == 0
    value = F.concat(
        F.lit('{"version":1,"type":'), F.when(even, '"detail"').otherwise('"index"'), F.lit(',"domains":["F'), F.col("p_partkey").cast("string"),
        F.lit('.example.com","shared.example.com"],"fields":'), F.when(even, '{"title":"t"}}').otherwise('{"postings":"jobs","posting_url":"url"}}'),
    )
    for size, (text, _) in enumerate(SPOILED, 1):
        value = F.when(F.col("p_size") == size, F.lit(text)).otherwise(value)
    return p.select(F.col("p_partkey").cast("string").alias("name"), value.alias("value"))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


@query(
    "rule_refusals",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS name, reason FROM part JOIN (VALUES {", ".join(f"({n}, {_quoted(r)})" for n, (_, r) in enumerate(SPOILED, 1))}) AS t(size, reason)
    ON p_size = size""",
)
def rule_refusals(spark, sf):
    judged = R.judged_documents(rule_files(spark, sf))
    return judged.filter(F.col("reason").isNotNull()).select("name", "reason")


@query(
    "rule_documents",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_size % 2 = 0 THEN 'detail' ELSE 'index' END AS kind,
    unnest(['f' || p_partkey || '.example.com', 'shared.example.com']) AS domain FROM part WHERE p_size > {len(SPOILED)}""",
)
def rule_documents(spark, sf):
    """The accepted documents by the domains they serve."""
    return R.document_rules(R.judged_documents(rule_files(spark, sf)))


@query(
    "registered_functions",
    """SELECT o_orderkey, 'A & B ' || o_orderstatus AS plain, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey / 100.0 END AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'year' WHEN 'O' THEN 'hour' END AS period FROM orders""",
)
def registered_functions(spark, sf):
    """The mapping functions in SQL text, as a rule's expressions use them."""
    register_functions(spark)
    doc = F.concat(F.lit('{"cents":'), F.when(F.col("o_orderstatus") == "P", '"none"').otherwise(F.col("o_orderkey").cast("string")), F.lit("}"))
    said = F.when(F.col("o_orderstatus") == "F", "Annual Salary").when(F.col("o_orderstatus") == "O", "per hour").otherwise("per hour or per year")
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("A &amp; B "), "o_orderstatus").alias("text"), F.try_parse_json(doc).alias("doc"), said.alias("said"))
    return rows.selectExpr("o_orderkey", "unescape(text) AS plain", "hundredths(variant_get(doc, '$.cents', 'variant')) AS amount", "pay_period(said) AS period")
