"""Bronze documents to Silver, refusals and learning requests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanwork.operators import quality as Q
from gleanwork.operators import rules as R
from gleanwork.operators import silver as S
from gleanwork.plans.ingest import ingest_silver
from gleanwork.queries.mapping import FEED, all_rules, order_documents
from gleanwork.queries.registry import as_uuid, query, sql_text, table, text

NOW = datetime(2024, 2, 1)

JUDGED = f"""
j AS (SELECT *, 'https://jobs.example.com/p/' || o_orderkey AS url,
        CASE o_orderstatus WHEN 'O' THEN '{FEED}' WHEN 'F' THEN 'api.acme.example.com' ELSE 'nowhere' || (o_custkey % 5) || '.example.com' END AS domain,
        CASE WHEN o_totalprice < 40000 THEN 'unparseable_content' WHEN o_orderstatus = 'P' THEN 'no_rule'
             WHEN o_totalprice BETWEEN 120000 AND 140000 THEN 'rule_raised'
             WHEN o_totalprice BETWEEN 60000 AND 80000 OR o_totalprice BETWEEN 80000 AND 100000 OR o_totalprice BETWEEN 140000 AND 160000
             THEN 'invalid_shape' END AS reason,
        CASE WHEN o_totalprice < 20000 THEN 'malformed JSON' WHEN o_totalprice < 30000 THEN 'int' WHEN o_totalprice < 40000 THEN 'str'
             WHEN o_orderstatus = 'P' THEN NULL WHEN o_totalprice BETWEEN 120000 AND 140000 THEN 'unescape() expects a string, found array'
             WHEN o_totalprice BETWEEN 60000 AND 80000 THEN '''company_name'' must be a non-blank string'
             WHEN o_totalprice BETWEEN 80000 AND 100000 THEN '''description'' must be a non-blank string'
             WHEN o_totalprice BETWEEN 140000 AND 160000 THEN '''locations'' must be a list of strings' END AS detail
      FROM orders)"""


def batch(spark, sf):
    rules, winners = all_rules(spark)
    return ingest_silver(order_documents(spark, sf, broken=True), rules, winners, F.lit(NOW))


@query("shape_refusals", f"WITH {JUDGED} SELECT url AS posting_url, domain, 'detail' AS stage, reason, detail FROM j WHERE reason IS NOT NULL")
def shape_refusals(spark, sf):
    return batch(spark, sf).events.select("posting_url", "domain", "stage", "reason", "detail")


@query(
    "silver_rows",
    f"""WITH {JUDGED} SELECT url, o_orderpriority AS title, CASE WHEN o_orderstatus = 'F' THEN 'F' END AS employment_type,
    CASE WHEN o_totalprice BETWEEN 100000 AND 120000 THEN '' ELSE 'Year ' || year(o_orderdate) || '|Zürich' END AS locations,
    CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE '' END AS categories,
    CASE WHEN o_orderstatus = 'O' THEN '{{"location_type":"On-Site"}}' ELSE '{{"order":' || o_orderkey || '}}' END AS metadata,
    CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice, 2) END AS pay_min, CASE WHEN o_orderstatus = 'O' THEN 'EUR' END AS pay_currency
    FROM j WHERE reason IS NULL""",
)
def silver_rows(spark, sf):
    return batch(spark, sf).accepted.select(
        "url", "title", "employment_type",
        F.array_join("locations", "|").alias("locations"), F.array_join("categories", "|").alias("categories"),
        F.to_json("metadata").alias("metadata"), F.col("pay_min").cast("double").alias("pay_min"), "pay_currency",
    )


@query("detail_requests", f"WITH {JUDGED} SELECT domain AS host, count(*) AS postings FROM j WHERE reason = 'no_rule' GROUP BY domain")
def detail_requests(spark, sf):
    return batch(spark, sf).detail_requests.groupBy("host").agg(F.count(F.lit(1)).alias("postings"))


@query("refusal_report", f"WITH {JUDGED} SELECT domain, 'detail' AS stage, reason, count(*) AS count FROM j WHERE reason IS NOT NULL GROUP BY domain, reason")
def refusal_report(spark, sf):
    return Q.refusal_report(batch(spark, sf).events)


@query("refusal_rollup", f"WITH {JUDGED} SELECT domain, reason, count(*) AS count FROM j WHERE reason IS NOT NULL GROUP BY ROLLUP (domain, reason)")
def refusal_rollup(spark, sf):
    return Q.refusal_rollup(batch(spark, sf).events)


RAW_RULE = {
    "version": 1,
    "type": "detail",
    "domains": ["raw.example.com"],
    "fields": {"title": "t", "company_name": "c", "description": "d", "metadata": "m", "employment_type": "e", "locations": "l"},
}


@query(
    "shape_kinds",
    """SELECT 'https://x.io/' || o_orderkey AS posting_url, CASE o_orderkey % 6 WHEN 0 THEN '''metadata'' must be an object'
    WHEN 1 THEN '''employment_type'' must be a string' WHEN 2 THEN '''locations'' must be a list of strings' WHEN 3 THEN '''metadata'' must be an object' END AS detail
    FROM orders WHERE o_orderkey % 6 < 4""",
)
def shape_kinds(spark, sf):
    """Fields of the wrong kind, the first of them told."""
    key = F.col("o_orderkey") % 6
    doc = F.concat(
        F.lit('{"t":"x","c":"y","d":"z","m":'), F.when(key == 0, "[1]").when(key == 3, '"text"').otherwise('{"a":1}'),
        F.lit(',"e":'), F.when(key.isin(0, 1), "5").when(key == 4, "null").otherwise('"full"'), F.lit(',"l":'), F.when(key == 2, '["a",1]').otherwise('["a"]'), F.lit("}"),
    )
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("https://x.io/"), F.col("o_orderkey").cast("string")).alias("url"), doc.alias("raw_content"), F.lit("application/json").alias("content_type"),
        F.lit("https://raw.example.com/feed").alias("source_url"), F.lit(None).cast("string").alias("start_url_id"),
    )
    rules = [R.parse_rule(RAW_RULE)]
    return ingest_silver(rows, rules, R.resolve_rules(R.rules_table(spark, rules))[0], F.lit(NOW)).events.select("posting_url", "detail")


def _taken_as_is(slice_of_domain):
    """Code for a domain: the feed's own words, whatever a rule would read."""
    doc = F.try_parse_json("raw_content")
    absent = F.lit(None).cast("variant")
    said = {"title": F.upper(F.try_variant_get(doc, "$.title", "string")), "company_name": F.lit("by code"), "description": F.try_variant_get(doc, "$.content", "string")}
    mapped = F.struct(*[(said[f].cast("variant") if f in said else absent).alias(f) for f in R.SILVER_FIELDS])
    return slice_of_domain.withColumn("mapped", mapped)


@query(
    "custom_domain",
    """SELECT 'https://jobs.example.com/p/' || o_orderkey AS url, upper(o_orderpriority) AS title, 'by code' AS company_name
    FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 5 = 3""",
)
def custom_domain(spark, sf):
    """Code serves one of the hosts that no rule knows; rules serve the others as before."""
    rules, winners = all_rules(spark)
    served = ingest_silver(order_documents(spark, sf), rules, winners, F.lit(NOW), custom={(R.DETAIL, "nowhere3.example.com"): _taken_as_is})
    return served.accepted.filter("company_name = 'by code'").select("url", "title", "company_name")


def page_batch(spark, sf, rules):
    """The given pages as Bronze rows, each with its own url."""
    rows = table(spark, sf, "pages").select(
        "url", F.col("html").alias("raw_content"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.col("url").alias("source_url"), F.lit(None).cast("string").alias("start_url_id"),
    )
    return ingest_silver(rows, *rules, F.lit(NOW))


@query("page_requests", "SELECT url, html AS html_content FROM pages")
def page_requests(spark, sf):
    """No page rule serves the given hosts, so every page asks for one."""
    return page_batch(spark, sf, all_rules(spark)).page_requests


POSTING_RULE = {
    "version": 1,
    "type": "extraction",
    "domains": ["postings.example.com"],
    "fields": {
        "panel": {"tag": "div", "class": "posting"},
        "title": {"tag": "h2"},
        "chips": {
            "row": {"tag": "div", "class": "chips"}, "icon": {"tag": "i"}, "company": "firm", "location": "place", "level": "level",
            "location_value": {"tag": "b"}, "level_value": {"tag": "em"},
        },
        "note": "following:",
        "sections": {"heading": "h3"},
    },
}

# A word of the page's own text stands for each field; a third of the pages lack a section's
# heading, some have no posting, and some come from a host without a rule.
POSTING = """
pg AS (SELECT page_id, regexp_extract(html, 'href="/([A-Za-zÀ-ÿ]+)"', 1) AS firm, regexp_extract(html, '<h1>([A-Za-zÀ-ÿ]+)', 1) AS title,
              'https://' || CASE WHEN page_id % 5 = 4 THEN 'nobody' ELSE 'postings' END || '.example.com/' || page_id AS url, html LIKE '%</body>%' AS whole FROM pages),
oc AS (SELECT *, CASE WHEN page_id % 5 = 4 THEN 'no_rule' WHEN page_id % 5 = 3 OR NOT whole THEN 'empty_result'
              WHEN page_id % 3 = 0 OR firm = '' OR title = '' THEN 'missing_required' ELSE 'accepted' END AS outcome FROM pg)"""


def posting_pages(spark, sf):
    """The given pages with a posting put before their end, read by a rule and judged."""
    p = table(spark, sf, "pages", spread=True)
    key = F.col("page_id")
    firm, title = F.regexp_extract("html", 'href="/([A-Za-zÀ-ÿ]+)"', 1), F.regexp_extract("html", "<h1>([A-Za-zÀ-ÿ]+)", 1)
    heading = F.when(key % 3 == 0, "<p>Duties</p>").otherwise("<h3>Duties</h3>")
    posting = F.concat(
        F.lit('<div class="posting"><h2> '), title, F.lit('</h2><div class="chips"><span><i>firm</i> '), firm,
        F.lit("</span><span><i>place</i><b>Zurich</b><b>; Bern</b></span></div><div>"), heading, F.lit("<ul><li>One</li><li>Two</li></ul></div></div></body>"),
    )
    url = F.concat(F.lit("https://"), F.when(key % 5 == 4, "nobody").otherwise("postings"), F.lit(".example.com/"), key.cast("string"))
    rows = p.select(
        url.alias("url"), F.when(key % 5 == 3, F.col("html")).otherwise(F.replace(F.col("html"), F.lit("</body>"), posting)).alias("raw_content"),
        F.lit("text/html").alias("content_type"), url.alias("source_url"), F.lit(None).cast("string").alias("start_url_id"),
    )
    rules = [R.parse_rule(POSTING_RULE)]
    return ingest_silver(rows, rules, R.resolve_rules(R.rules_table(spark, rules))[0], F.lit(NOW))


@query(
    "page_silver",
    f"""WITH {POSTING} SELECT url, title, firm AS company_name, 'Zurich|Bern' AS locations, '# Duties' || chr(10) || chr(10) || '- One' || chr(10) || '- Two' AS description
    FROM oc WHERE outcome = 'accepted'""",
)
def page_silver(spark, sf):
    """Detail pages into typed rows."""
    rows = posting_pages(spark, sf).accepted
    return rows.select("url", "title", "company_name", F.array_join("locations", "|").alias("locations"), "description")


@query("page_refusals", f"WITH {POSTING} SELECT url, outcome FROM oc")
def page_refusals(spark, sf):
    """What became of each page."""
    return posting_pages(spark, sf).outcomes.select("url", "outcome")


def event_silver(spark, sf, kinds):
    """One typed row per user from the newest of its events of some kinds."""
    e = table(spark, sf, "events").filter(F.col("event_type").isin(*kinds))
    newest = e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value", "props"), "event_id").alias("e"))
    return newest.select(
        F.concat(F.lit("https://jobs.example.com/u/"), F.col("user_id").cast("string")).alias("url"),
        F.col("e.event_type").alias("title"),
        F.lit("Acme").alias("company_name"),
        F.lit(None).cast("string").alias("employment_type"),
        F.array("e.event_type").alias("locations"),
        F.array().cast("array<string>").alias("categories"),
        F.col("e.props").alias("description"),
        F.try_parse_json("e.props").alias("metadata"),
        F.when(F.col("e.value") > 50, F.col("e.value").cast("decimal(12,2)")).alias("pay_min"),
        F.lit(None).cast("decimal(12,2)").alias("pay_max"),
        F.lit("EUR").alias("pay_currency"),
        F.lit("hour").alias("pay_period"),
    )


@query(
    "silver_upsert",
    f"""WITH o AS (SELECT user_id, max(event_id) AS id FROM events WHERE event_type IN ('view', 'error') GROUP BY 1),
    n AS (SELECT user_id, max(event_id) AS id FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY 1)
    SELECT 'https://jobs.example.com/u/' || coalesce(o.user_id, n.user_id) AS url,
           CASE WHEN o.user_id IS NULL THEN {as_uuid("substr(sha256('https://jobs.example.com/u/' || n.user_id), 1, 32)")} ELSE 'old-' || o.user_id END AS id,
           e.event_type AS title, e.props AS description, CASE WHEN e.value > 50 THEN round(e.value, 2) END AS pay_min,
           {sql_text("CASE WHEN o.user_id IS NULL THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2023-01-01' END")} AS created_at,
           {sql_text("CASE WHEN n.user_id IS NULL THEN TIMESTAMP '2023-01-01' ELSE TIMESTAMP '2024-02-01' END")} AS updated_at
    FROM o FULL JOIN n ON o.user_id = n.user_id JOIN events AS e ON e.event_id = coalesce(n.id, o.id)""",
)
def silver_upsert(spark, sf):
    then = F.lit(datetime(2023, 1, 1))
    number = F.regexp_extract("url", r"(\d+)$", 1)
    old = event_silver(spark, sf, ("view", "error"))
    stored = old.withColumns(
        {"id": F.concat(F.lit("old-"), number), "created_at": then, "updated_at": then, "deleted_at": F.lit(None).cast("timestamp")}
    )
    new = event_silver(spark, sf, ("signup", "purchase"))
    merged = S.silver_upsert(stored, new, F.lit(NOW))
    return merged.select(
        "url", "id", "title", "description", F.col("pay_min").cast("double").alias("pay_min"),
        text(F.col("created_at")).alias("created_at"), text(F.col("updated_at")).alias("updated_at"),
    )
