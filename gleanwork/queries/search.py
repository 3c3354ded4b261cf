"""Search, paging and facets over postings made of `orders`, `part` and `documents`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanwork.functions.ids import url_key
from gleanwork.functions.text import facet_label
from gleanwork.operators import search as S
from gleanwork.plans import serve
from gleanwork.operators.steps import written
from gleanwork.queries.registry import as_uuid, query, sql_text, table, text


def order_postings(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("https://jobs.example.com/p/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.col("o_orderpriority"), F.lit(" % "), F.col("o_orderstatus")).alias("title"),
        F.concat(F.lit("Customer_"), F.col("o_custkey").cast("string")).alias("company_name"),
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("employment_type"),
        F.when(
            F.col("o_orderstatus") != "P",
            F.array(
                F.concat(F.lit("Year "), F.year("o_orderdate").cast("string")),
                F.concat(F.lit("Month "), F.month("o_orderdate").cast("string")),
                F.concat(F.lit("Year "), F.year("o_orderdate").cast("string")),
            ),
        ).alias("locations"),
        F.col("o_orderdate").alias("created_at"),
        F.when((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000), F.col("o_orderdate")).alias("deleted_at"),
    )


ORDERS = """
p AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id,
             'https://jobs.example.com/p/' || o_orderkey AS url,
             o_orderpriority || ' % ' || o_orderstatus AS title,
             'Customer_' || o_custkey AS company_name,
             nullif(o_orderpriority, '4-NOT SPECIFIED') AS employment_type,
             CASE WHEN o_orderstatus <> 'P' THEN ['Year ' || year(o_orderdate), 'Month ' || month(o_orderdate)] END AS locations,
             o_orderdate AS created_at,
             CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN o_orderdate END AS deleted_at
      FROM orders)"""

PICK = S.Selection(
    q="Er_1",
    locations=("Year 1997", "Year 1996", "Month 3"),
    companies=(),
    employment_types=("1-URGENT", "2-HIGH", "__unspecified__"),
)
TERM = "(contains(lower(title), 'er_1') OR contains(lower(company_name), 'er_1'))"
TYPES = "(employment_type IN ('1-URGENT', '2-HIGH') OR employment_type IS NULL)"
PLACES = "(locations IS NOT NULL AND list_has_any(locations, ['Year 1997', 'Year 1996', 'Month 3']))"
MATCHED = f"WHERE deleted_at IS NULL AND {TERM} AND {TYPES} AND {PLACES}"


def page_columns(df):
    return df.select("id", "title", "company_name", "employment_type", text(F.col("created_at")).alias("first_seen"))


SQL_PAGE = f"id, title, company_name, employment_type, {sql_text('created_at')} AS first_seen"


@query(
    "search_literal",
    """
    SELECT p_partkey, q FROM part, (VALUES ('RE'), ('_'), ('%'), ('d#1')) AS t(q)
    WHERE contains(lower(p_name), lower(q)) OR contains(lower(p_brand), lower(q))""",
)
def search_literal(spark, sf):
    parts = table(spark, sf, "part")
    found = None
    for q in ("RE", "_", "%", "d#1"):
        hits = parts.filter(S.search_text(q, F.col("p_name"), F.col("p_brand"))).select(
            "p_partkey", F.lit(q).alias("q")
        )
        found = hits if found is None else found.unionByName(hits)
    return found


@query("search_page", f"WITH {ORDERS} SELECT {SQL_PAGE} FROM p {MATCHED} ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 50")
def search_page(spark, sf):
    return page_columns(S.page(S.matching(order_postings(spark, sf), PICK), 3))


@query("search_oldest", f"WITH {ORDERS} SELECT {SQL_PAGE} FROM p ORDER BY created_at, id LIMIT 25")
def search_oldest(spark, sf):
    """No term, closed ones included."""
    everything = S.Selection(q="", include_closed=True)
    return page_columns(S.page(S.matching(order_postings(spark, sf), everything), 1, "oldest"))


@query(
    "search_after",
    f"""WITH {ORDERS} SELECT {SQL_PAGE} FROM p
    WHERE deleted_at IS NULL AND (created_at < TIMESTAMP '1997-06-01' OR (created_at = TIMESTAMP '1997-06-01' AND id < '000000005000'))
    ORDER BY created_at DESC, id DESC LIMIT 25""",
)
def search_after(spark, sf):
    matched = S.matching(order_postings(spark, sf), S.Selection())
    return page_columns(S.page_after(matched, F.lit(datetime(1997, 6, 1)), F.lit("000000005000")))


@query(
    "page_totals",
    f"""WITH {ORDERS} SELECT count(*) AS total, count(DISTINCT company_name) AS company_count,
    greatest(1, CAST(ceil(count(*) / 25.0) AS BIGINT)) AS last_page FROM p {MATCHED}""",
)
def page_totals(spark, sf):
    return S.page_totals(S.matching(order_postings(spark, sf), PICK))


@query(
    "page_totals_approx",
    f"""WITH {ORDERS}, c AS (
        SELECT 1 AS n, count(*) AS total, count(DISTINCT company_name) AS exact FROM p WHERE deleted_at IS NULL AND {TYPES} AND {PLACES}
        UNION ALL SELECT 2, count(*), count(DISTINCT company_name) FROM p WHERE deleted_at IS NULL
        UNION ALL SELECT 3, count(*), count(DISTINCT company_name) FROM p WHERE deleted_at IS NULL AND employment_type = 'no such type')
    SELECT n AS selection, total, greatest(1, CAST(ceil(total / 25.0) AS BIGINT)) AS last_page, exact AS companies, true AS within FROM c""",
)
def page_totals_approx(spark, sf):
    """Three selections answered from the cells, and held against the exact count: within
    five standard errors."""
    postings = order_postings(spark, sf)
    cells = written(S.facet_sketches(postings))
    found = []
    picks = (S.Selection(locations=PICK.locations, employment_types=PICK.employment_types), S.Selection(), S.Selection(employment_types=("no such type",)))
    for n, pick in enumerate(picks, 1):
        exact = S.page_totals(S.matching(postings, pick)).select(F.col("total"), F.col("company_count").alias("companies"))
        both = S.page_totals_approx(cells, pick).join(exact, "total")  # one row each
        within = F.abs(F.col("company_count") - F.col("companies")) <= 5 * 1.04 / 2**7 * F.col("companies")
        found.append(both.select(F.lit(n).alias("selection"), "total", "last_page", "companies", within.alias("within")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "page_clamped",
    f"""WITH {ORDERS}, t AS (SELECT count(*) AS total FROM p {MATCHED})
    SELECT n AS requested, greatest(1, least(n, greatest(1, CAST(ceil(total / 25.0) AS BIGINT)))) AS page
    FROM t, (VALUES (-3), (1), (2), (1000000)) AS v(n)""",
)
def page_clamped(spark, sf):
    totals = S.page_totals(S.matching(order_postings(spark, sf), PICK))
    asked = totals.select("total", F.explode(F.array(*[F.lit(n).cast("bigint") for n in (-3, 1, 2, 1000000)])).alias("requested"))
    return asked.select("requested", S.clamp_page(F.col("requested"), F.col("total")).alias("page"))


COMPANY = f"""SELECT 'company' AS facet, company_name AS value, count(*) AS count FROM p
    WHERE deleted_at IS NULL AND {TERM} AND {TYPES} AND {PLACES} GROUP BY company_name"""
TYPE = f"""SELECT 'employment_type' AS facet, coalesce(employment_type, '__unspecified__') AS value, count(*) AS count FROM p
    WHERE deleted_at IS NULL AND {TERM} AND {PLACES} GROUP BY employment_type"""
LOCATION = f"""SELECT 'location' AS facet, value, count(*) AS count FROM
    (SELECT unnest(list_distinct(locations)) AS value FROM p WHERE deleted_at IS NULL AND {TERM} AND {TYPES}) GROUP BY value"""


@query("facet_company", f"WITH {ORDERS} {COMPANY}")
def facet_company(spark, sf):
    return S.facet_counts(order_postings(spark, sf), PICK, ("company",))


@query("facet_unspecified", f"WITH {ORDERS} {TYPE}")
def facet_unspecified(spark, sf):
    return S.facet_counts(order_postings(spark, sf), PICK, ("employment_type",))


@query(
    "facet_never_reported",
    f"""WITH {ORDERS} SELECT 'company' AS facet, company_name AS value, count(*) AS count FROM p
    WHERE deleted_at IS NULL GROUP BY company_name""",
)
def facet_never_reported(spark, sf):
    """No posting states a type: the facet is absent, not one unspecified bucket."""
    untyped = order_postings(spark, sf).withColumn("employment_type", F.lit(None).cast("string"))
    return S.facet_counts(untyped, S.Selection(), ("company", "employment_type"))


@query(
    "facet_array",
    """SELECT 'location' AS facet, value, count(*) AS count FROM
    (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS value FROM part) GROUP BY value""",
)
def facet_array(spark, sf):
    parts = table(spark, sf, "part").select(
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("company_name"),
        F.col("p_type").alias("employment_type"),
        F.split("p_name", " ").alias("locations"),
        F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    return S.facet_counts(parts, S.Selection(), ("location",))


@query("facet_siblings", f"WITH {ORDERS} {COMPANY} UNION ALL {TYPE} UNION ALL {LOCATION}")
def facet_siblings(spark, sf):
    return S.ordered_facets(S.facet_counts(order_postings(spark, sf), PICK))


DISPLAY = S.Selection(
    locations=("Month 3", "Atlantis"), companies=("Customer_1",), employment_types=("5-LOW", "__unspecified__")
)


@query(
    "facet_display",
    f"""WITH {ORDERS},
    m AS (SELECT *, (locations IS NOT NULL AND list_has_any(locations, ['Month 3', 'Atlantis'])) AS ml,
                 company_name = 'Customer_1' AS mc,
                 (employment_type IS NULL OR employment_type = '5-LOW') AS mt FROM p WHERE deleted_at IS NULL),
    c AS (SELECT 'company' AS facet, company_name AS value, count(*) AS count FROM m WHERE ml AND mt GROUP BY 2
          UNION ALL SELECT 'employment_type', coalesce(employment_type, '__unspecified__'), count(*) FROM m WHERE ml AND mc GROUP BY employment_type
          UNION ALL SELECT 'location', value, count(*) FROM (SELECT unnest(list_distinct(locations)) AS value FROM m WHERE mc AND mt) GROUP BY 2),
    kept AS (SELECT * FROM c WHERE NOT (facet = 'employment_type' AND NOT EXISTS
             (SELECT 1 FROM c AS r WHERE r.facet = 'employment_type' AND r.value <> '__unspecified__'))),
    s AS (SELECT * FROM (VALUES ('location', 'Month 3', 0), ('location', 'Atlantis', 1), ('company', 'Customer_1', 0),
                         ('employment_type', '5-LOW', 0), ('employment_type', '__unspecified__', 1)) AS t(facet, value, position)),
    r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS n FROM kept),
    l AS (SELECT facet, value, count, NULL AS position FROM r WHERE n <= 4 OR EXISTS
          (SELECT 1 FROM s WHERE s.facet = r.facet AND s.value = r.value)),
    a AS (SELECT * FROM l UNION ALL SELECT facet, value, 0, position FROM s WHERE NOT EXISTS
          (SELECT 1 FROM kept WHERE kept.facet = s.facet AND kept.value = s.value)),
    h AS (SELECT facet, (SELECT count(*) FROM kept WHERE kept.facet = l.facet) - count(*) AS hidden FROM l GROUP BY facet)
    SELECT a.facet, CASE WHEN value = '__unspecified__' THEN 'Unspecified' ELSE value END AS label, count,
           row_number() OVER (PARTITION BY a.facet ORDER BY position NULLS LAST, count DESC, value) AS place,
           coalesce(hidden, 0) AS hidden
    FROM a LEFT JOIN h ON a.facet = h.facet""",
)
def facet_display(spark, sf):
    shown = S.facet_display(S.facet_counts(order_postings(spark, sf), DISPLAY), DISPLAY)
    return shown.select(
        "facet",
        facet_label(F.col("value")).alias("label"),
        "count",
        F.col("place").cast("bigint").alias("place"),
        F.col("hidden").cast("bigint").alias("hidden"),
    )


def document_postings(spark, sf):
    """Postings whose descriptions are the documents' whole texts."""
    d = table(spark, sf, "documents", spread=True).join(table(spark, sf, "labels"), "doc_id", "left")
    url = F.concat(F.lit("https://jobs.example.com/d/"), F.col("doc_id").cast("string"))
    paid = F.col("n_chars") % 3 != 0
    return d.select(
        uuid_of("doc_id").alias("id"),
        url.alias("url"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("company_name"),
        F.nullif("lang", F.lit("de")).alias("employment_type"),
        F.when(F.col("lang") != "fr", F.array("lang", "source")).alias("locations"),
        F.when(F.col("lang") == "fr", F.array("source")).alias("categories"),
        F.concat(F.lit("# Role\n\n> see [the _docs_](https://x.io/a_b) for **all**\n\n"), F.col("text")).alias("description"),
        F.when(F.col("quality").isNotNull(), F.to_variant_object(F.struct("quality"))).alias("metadata"),
        F.when(paid, (F.col("n_chars") / 4).cast("decimal(12,2)")).alias("pay_min"),
        F.when(F.col("n_chars") % 3 == 1, F.col("n_chars").cast("decimal(12,2)")).alias("pay_max"),
        F.when(F.col("lang") != "es", F.lit("EUR")).alias("pay_currency"),
        F.lit("hour").alias("pay_period"),
        F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id")).alias("created_at"),
        F.timestamp_seconds(F.lit(1710000000) + F.col("doc_id")).alias("updated_at"),
        F.when(F.col("toxic") == 1, F.timestamp_seconds(F.lit(1720000000))).alias("deleted_at"),
    )


def uuid_of(column):
    digits = F.md5(F.col(column).cast("string"))
    return F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


# RE2 has no look-around: an underscore counts as inside a word when a letter, digit or
# underscore stands on both sides, so those are hidden behind a control character first.
SNIPPET = r"""left(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(
    {}, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'),
    '([\pL\pN\pM])_+([\pL\pN\pM])', '\1' || chr(1) || '\2', 'g'),
    '[#*`>_]+', '', 'g'), chr(1), '_'),
    '[\s\pZ\x0B]+', ' ', 'g')), 240)"""
DESCRIPTION = "'# Role\n\n> see [the _docs_](https://x.io/a_b) for **all**\n\n' || text"
DOCUMENTS = f"""
d AS (SELECT {as_uuid("md5(CAST(d.doc_id AS VARCHAR))")} AS id,
             'https://jobs.example.com/d/' || d.doc_id AS url, 'Document ' || d.doc_id AS title, source AS company_name,
             nullif(lang, 'de') AS employment_type,
             CASE WHEN lang <> 'fr' THEN lang || ',' || source ELSE '' END AS locations,
             CASE WHEN lang = 'fr' THEN source ELSE '' END AS categories, {DESCRIPTION} AS description,
             CASE WHEN quality IS NULL THEN '{{}}' ELSE '{{"quality":' || quality || '}}' END AS metadata,
             CASE WHEN n_chars % 3 <> 0 THEN CAST(round(n_chars / 4, 2) AS DOUBLE) END AS pay_min,
             CASE WHEN n_chars % 3 = 1 THEN CAST(n_chars AS DOUBLE) END AS pay_max,
             CASE WHEN lang <> 'es' THEN 'EUR' END AS pay_currency,
             make_timestamp((1700000000 + d.doc_id) * 1000000) AS created_at,
             make_timestamp((1710000000 + d.doc_id) * 1000000) AS updated_at, coalesce(toxic = 1, false) AS closed
      FROM documents AS d LEFT JOIN labels ON d.doc_id = labels.doc_id)"""
UTC = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"
SHARED = f"""id, url, title, company_name, employment_type, locations, categories, metadata,
    {UTC.format("created_at")} AS first_seen, {UTC.format("updated_at")} AS last_seen, closed"""


def flat(df):
    return df.withColumns(
        {
            "locations": F.array_join("locations", ","),
            "categories": F.array_join("categories", ","),
            "metadata": F.to_json("metadata"),
        }
    )


@query("posting_summary", f"WITH {DOCUMENTS} SELECT {SHARED}, {SNIPPET.format('description')} AS snippet FROM d")
def posting_summary(spark, sf):
    return flat(S.to_summary(document_postings(spark, sf)))


@query(
    "posting_detail",
    f"""WITH {DOCUMENTS}, q AS (SELECT *, pay_currency IS NOT NULL AND (pay_min IS NOT NULL OR pay_max IS NOT NULL) AS paid FROM d)
    SELECT {SHARED}, description, CASE WHEN paid THEN pay_min END AS min, CASE WHEN paid THEN pay_max END AS max,
    CASE WHEN paid THEN pay_currency END AS currency, CASE WHEN paid THEN 'hour' END AS period FROM q""",
)
def posting_detail(spark, sf):
    detail = flat(S.to_detail(document_postings(spark, sf)))
    return detail.select("*", "pay.min", "pay.max", "pay.currency", "pay.period").drop("pay")


@query(
    "posting_lookup",
    f"""WITH {DOCUMENTS} SELECT id, url FROM d WHERE id = '{"c4ca4238-a0b9-2382-0dcc-509a6f75849b"}'""",
)
def posting_lookup(spark, sf):
    """The id in another spelling, and a text that is no id and finds nothing."""
    postings = document_postings(spark, sf)
    found = S.get_posting(postings, "{C4CA4238A0B923820DCC509A6F75849B}")
    return found.unionByName(S.get_posting(postings, "not-an-id")).select("id", "url")


@query(
    "search_request",
    f"""WITH {DOCUMENTS} SELECT id, title, {SNIPPET.format('description')} AS snippet FROM d
    WHERE NOT closed AND company_name IN ('src0', 'src1', 'src2') ORDER BY created_at DESC, id DESC LIMIT 25 OFFSET 25""",
)
def search_request(spark, sf):
    """Page two of a request, found on narrow columns and read in full for its rows only."""
    pick = S.Selection(companies=("src0", "src1", "src2"))
    return serve.search(document_postings(spark, sf), pick, 2).page.select("id", "title", "snippet")


@query("row_keys", "SELECT o_orderkey, " + as_uuid("substr(sha256('https://jobs.example.com/p/' || o_orderkey), 1, 32)") + " AS id FROM orders")
def row_keys(spark, sf):
    return order_postings(spark, sf).select(
        F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("o_orderkey"), url_key(F.col("url")).alias("id")
    )
