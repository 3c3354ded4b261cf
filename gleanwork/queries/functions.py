"""Column functions over the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions import ids, pay, text, urls
from gleanwork.operators import learning
from gleanwork.queries.registry import as_uuid, query, table


@query(
    "url_functions",
    """SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS host,
    regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '[^a-z0-9]+', '_', 'g') AS slug,
    regexp_replace(replace(url, '&ref=x', ''), '[?]utm_source=feed', '') AS stripped,
    CASE WHEN contains(url, 'page=2') THEN replace(url, 'page=2', 'page=3') WHEN contains(url, '?') THEN url || '&page=2'
         WHEN contains(url, '#') THEN regexp_replace(url, '#', '?page=2#') ELSE url || '?page=2' END AS next_page
    FROM pages""",
)
def url_functions(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id",
        urls.url_host(url).alias("host"),
        urls.domain_slug(urls.url_host(url)).alias("slug"),
        urls.strip_params(urls.strip_params(url, "ref"), "utm_").alias("stripped"),
        urls.next_page_url(url).alias("next_page"),
    )


REFS = ("../up", "near?x=1", "#part", "?q=2", "/root/./a/../b", "//other.example.org/z", "https://abs.example.org/")


@query(
    "url_join",
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '^https?:', 0) AS scheme, regexp_extract(url, '^https?://[^/]*', 0) AS site,
                  regexp_extract(url, '^[^?#]*', 0) AS bare, regexp_extract(url, '^[^#]*', 0) AS whole FROM pages),
    r AS (SELECT page_id, url, ref, CASE ref
        WHEN '../up' THEN regexp_replace(bare, '[^/]+/[^/]*$', 'up')
        WHEN 'near?x=1' THEN regexp_replace(bare, '[^/]*$', 'near?x=1')
        WHEN '#part' THEN whole || '#part'
        WHEN '?q=2' THEN bare || '?q=2'
        WHEN '/root/./a/../b' THEN site || '/root/b'
        WHEN '//other.example.org/z' THEN scheme || '//other.example.org/z'
        ELSE ref END AS joined FROM p, (VALUES ('../up'), ('near?x=1'), ('#part'), ('?q=2'), ('/root/./a/../b'), ('//other.example.org/z'), ('https://abs.example.org/')) AS t(ref))
    SELECT page_id, ref, joined FROM r""",
)
def url_join(spark, sf):
    refs = F.array(*[F.lit(r) for r in REFS])
    pages = table(spark, sf, "pages").select("page_id", "url", F.explode(refs).alias("ref"))
    return pages.select("page_id", "ref", urls.url_join(F.col("url"), F.col("ref")).alias("joined"))


@query(
    "filter_params",
    """SELECT s_suppkey, 'team[]=' || s_suppkey || '|x y;on=1' AS params, 'https://x.example.com/jobs?per=50' AS stripped FROM supplier""",
)
def filter_params(spark, sf):
    key = F.col("s_suppkey").cast("string")
    url = F.concat(F.lit("https://x.example.com/jobs?filter.team[]="), key, F.lit("&per=50&%66ilter.on=1&filter.team[]=x+y"))
    shown = F.array_join(
        F.transform(urls.filter_params(url), lambda g: F.concat(g["key"], F.lit("="), F.array_join(g["values"], "|"))), ";"
    )
    return table(spark, sf, "supplier").select("s_suppkey", shown.alias("params"), urls.strip_filter_params(url).alias("stripped"))


@query(
    "media_types",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'application/json' WHEN 'N' THEN 'text/html' ELSE 'text/plain' END AS media_type,
    l_returnflag = 'A' AS mapped FROM lineitem""",
)
def media_types(spark, sf):
    from gleanwork.operators.silver import is_mapped

    header = (
        F.when(F.col("l_returnflag") == "A", "Application/JSON; charset=utf-8")
        .when(F.col("l_returnflag") == "R", " text/plain ;q=1")
    )
    bare = urls.bare_media_type(header)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", bare.alias("media_type"), is_mapped(bare).alias("mapped")
    )


@query(
    "uuid_parsing",
    f"SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN {as_uuid('md5(CAST(o_orderkey AS VARCHAR))')} END AS id FROM orders",
)
def uuid_parsing(spark, sf):
    digits = F.md5(F.col("o_orderkey").cast("string"))
    spelled = (
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("{"), F.upper(digits), F.lit("}")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("urn:uuid:"), digits))
        .otherwise(F.substring(digits, 1, 31))
    )
    return table(spark, sf, "orders").select("o_orderkey", ids.uuid_or_null(spelled).alias("id"))


@query("unescape", "SELECT doc_id, text FROM documents")
def unescape(spark, sf):
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("é"), F.lit("&eacute;"))
    return table(spark, sf, "documents").select("doc_id", text.unescape(escaped).alias("text"))


@query("decode_body", "SELECT doc_id, text FROM documents")
def decode_body(spark, sf):
    """Documents as JSON bodies in four encodings, told apart by their bytes alone."""
    body = F.to_json(F.struct("text"))
    raw = (
        F.when(F.col("lang") == "fr", F.encode(body, "UTF-16"))
        .when(F.col("lang") == "de", F.encode(body, "UTF-16LE"))
        .when(F.col("lang") == "es", F.encode(body, "UTF-32"))
        .otherwise(F.encode(body, "UTF-8"))
    )
    decoded = table(spark, sf, "documents", spread=True).select("doc_id", D.parse_document(text.decode_body(raw)).alias("doc"))
    return decoded.select("doc_id", F.try_variant_get("doc", "$.text", "string").alias("text"))


@query(
    "relative_time",
    """WITH m AS (SELECT event_id, CAST(floor((epoch_ms(TIMESTAMP '2024-01-20 12:00:00') - epoch_ms(ts)) / 60000.0 + 0.5) AS BIGINT) AS minutes FROM events),
    h AS (SELECT *, CAST(floor(minutes / 60.0 + 0.5) AS BIGINT) AS hours FROM m)
    SELECT event_id, CASE WHEN minutes < 60 THEN greatest(minutes, 0) || 'm ago' WHEN hours < 24 THEN hours || 'h ago'
    ELSE CAST(floor(hours / 24.0 + 0.5) AS BIGINT) || 'd ago' END AS age FROM h""",
)
def relative_time(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", text.relative_time(F.col("ts"), F.lit(datetime(2024, 1, 20, 12))).alias("age")
    )


@query(
    "format_pay",
    """WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice) ELSE l_extendedprice END AS lo,
        CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_returnflag = 'A' THEN floor(l_extendedprice) ELSE l_extendedprice END + CASE WHEN l_tax > 0.04 THEN l_quantity ELSE 0 END END AS hi,
        CASE WHEN l_discount < 0.02 THEN '€' WHEN l_discount < 0.05 THEN '$' ELSE 'CHF' || chr(160) END AS s, l_returnflag = 'N' AS capped FROM lineitem),
    t AS (SELECT *, s || CASE WHEN lo = floor(lo) THEN format('{:,.0f}', lo) ELSE format('{:,.2f}', round(lo, 2)) END AS a,
        s || CASE WHEN hi = floor(hi) THEN format('{:,.0f}', hi) ELSE format('{:,.2f}', round(hi, 2)) END AS b FROM l)
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN hi IS NULL THEN 'from ' || a || '/year' WHEN capped THEN 'up to ' || b || '/year'
    WHEN lo = hi THEN a || '/year' ELSE a || ' – ' || b || '/year' END AS pay FROM t""",
)
def format_pay(spark, sf):
    low = F.when(F.col("l_returnflag") == "A", F.floor("l_extendedprice").cast("double")).otherwise(F.col("l_extendedprice"))
    extra = F.when(F.col("l_tax") > 0.04, F.col("l_quantity")).otherwise(0.0)
    high = F.when(F.col("l_linestatus") == "O", low + extra)
    capped = (F.col("l_returnflag") == "N") & high.isNotNull()
    currency = F.when(F.col("l_discount") < 0.02, "EUR").when(F.col("l_discount") < 0.05, "USD").otherwise("CHF")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        pay.format_pay(F.when(~capped, low), high, currency, F.lit("year")).alias("pay"),
    )


@query(
    "pay_period",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN CASE l_returnflag WHEN 'R' THEN 'hour' END
    ELSE CASE l_returnflag WHEN 'A' THEN 'year' WHEN 'N' THEN 'day' END END AS period FROM lineitem""",
)
def pay_period(spark, sf):
    label = F.concat(
        F.when(F.col("l_returnflag") == "A", "ANNUALLY paid").when(F.col("l_returnflag") == "N", "Daily-rate").otherwise("Monday holiday shift"),
        F.when(F.col("l_linestatus") == "O", " (40 hours)").otherwise(", weekend"),
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pay.pay_period(label).alias("period"))


def pay_documents(spark, sf):
    """One pay object per line item, spoiled in a way the line's columns choose."""
    line = table(spark, sf, "lineitem", spread=True)
    price, flag, n = F.col("l_extendedprice"), F.col("l_returnflag"), F.col("l_linenumber")
    low = F.when(n == 1, F.lit("true")).when(n == 2, F.lit("0")).when((n == 3) & (flag == "A"), F.lit("null")).otherwise(price.cast("decimal(12,3)").cast("string"))
    high = (
        F.when((n == 3), F.lit("null")).when((n == 4) & (flag == "A"), F.lit("1"))
        .when((n == 4) & (flag == "N"), F.lit("10000000000")).when((n == 4) & (flag == "R"), F.lit('"x"'))
        .otherwise((price + F.col("l_quantity")).cast("decimal(12,3)").cast("string"))
    )
    currency = F.when((n == 5) & (flag == "A"), F.lit('"eur"')).when((n == 5) & (flag == "N"), F.lit("null")).otherwise(F.lit('"EUR"'))
    period = F.when((n == 5) & (flag == "R"), F.lit('"decade"')).otherwise(F.lit('"year"'))
    extra = F.when((n == 6) & (flag == "A"), F.lit(',"note":1')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"min":'), low, F.lit(',"max":'), high, F.lit(',"currency":'), currency, F.lit(',"period":'), period, extra, F.lit("}"))
    whole = F.when((n == 6) & (flag == "N"), F.lit("[1,2]")).when((n == 6) & (flag == "R"), F.lit("null")).otherwise(body)
    return line.select("l_orderkey", "l_partkey", "l_suppkey", n.alias("l_linenumber"), F.try_parse_json(whole).alias("pay"))


PAY_RULE = """CASE WHEN l_linenumber = 1 THEN 'min_not_positive' WHEN l_linenumber = 2 THEN 'min_not_positive'
    WHEN l_linenumber = 3 AND l_returnflag = 'A' THEN 'no_bound'
    WHEN l_linenumber = 4 AND l_returnflag = 'A' THEN 'min_over_max' WHEN l_linenumber = 4 AND l_returnflag = 'N' THEN 'max_too_large'
    WHEN l_linenumber = 4 AND l_returnflag = 'R' THEN 'max_not_positive'
    WHEN l_linenumber = 5 AND l_returnflag IN ('A', 'N') THEN 'bad_currency' WHEN l_linenumber = 5 THEN 'bad_period'
    WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN 'wrong_keys' WHEN l_linenumber = 6 AND l_returnflag = 'N' THEN 'not_an_object' END"""


@query("pay_rules", f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {PAY_RULE} AS violation FROM lineitem")
def pay_rules(spark, sf):
    docs = pay_documents(spark, sf)
    return docs.withColumn("violation", pay.pay_violation(F.col("pay"))).drop("pay")


@query(
    "pay_columns",
    f"""WITH v AS (SELECT *, {PAY_RULE} IS NULL AND NOT (l_linenumber = 6 AND l_returnflag = 'R') AS valid FROM lineitem)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN valid THEN round(l_extendedprice, 2) END AS pay_min,
    CASE WHEN valid AND l_linenumber <> 3 THEN round(l_extendedprice + l_quantity, 2) END AS pay_max,
    CASE WHEN valid THEN 'EUR' END AS pay_currency, CASE WHEN valid THEN 'year' END AS pay_period FROM v""",
)
def pay_columns(spark, sf):
    columns = [
        (c.cast("double") if n in ("pay_min", "pay_max") else c).alias(n) for n, c in pay.pay_columns(F.col("pay")).items()
    ]
    return pay_documents(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *columns)


@query(
    "hundredths",
    "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN round(o_totalprice, 2) END AS amount FROM orders",
)
def hundredths(spark, sf):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    value = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit('"'), cents, F.lit('"'))).otherwise(cents)
    return table(spark, sf, "orders").select("o_orderkey", pay.hundredths(F.try_parse_json(value)).alias("amount"))


@query(
    "json_salvage",
    """SELECT conv_id, turn, CASE WHEN role = 'assistant' OR turn = 0 THEN text END AS text, CASE WHEN role = 'assistant' OR turn = 0 THEN conv_id END AS n FROM conversations""",
)
def json_salvage(spark, sf):
    """Whole replies, replies wrapped in prose, and lists and prose that hold no object."""
    body = F.to_json(F.struct("text", F.col("conv_id").alias("n")))
    reply = (
        F.when(F.col("turn") == 0, body)
        .when(F.col("role") == "assistant", F.concat(F.lit("Sure, here:\n```json\n"), body, F.lit("\n```\nDone.")))
        .otherwise(F.lit("[1, 2]"))
    )
    found = table(spark, sf, "conversations").select("conv_id", "turn", D.json_salvage(reply).alias("doc"))
    return found.select(
        "conv_id", "turn", F.try_variant_get("doc", "$.text", "string").alias("text"), F.try_variant_get("doc", "$.n", "bigint").alias("n")
    )


BLANK = r"'^[\s\pZ\x0B\x1C-\x1F\x85]+|[\s\pZ\x0B\x1C-\x1F\x85]+$'"


@query("strip_fences", f"SELECT doc_id, regexp_replace(text, {BLANK}, '', 'g') || chr(10) AS text FROM documents")
def strip_fences(spark, sf):
    wrapped = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .when(F.col("lang") == "de", F.concat(F.lit("  ```python\n"), "text", F.lit("\n```  \n")))
        .when(F.col("lang") == "es", F.concat("text", F.lit("\n```")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select("doc_id", text.strip_fences(wrapped).alias("text"))


@query("head_budget", "SELECT doc_id, left(text, 1200) AS head, length(left(text, 1200)) AS size FROM documents")
def head_budget(spark, sf):
    head = text.head_budget(F.col("text"), 1200)
    return table(spark, sf, "documents").select("doc_id", head.alias("head"), F.length(head).cast("bigint").alias("size"))


def listings(spark, sf):
    """One API response per order: a JSON document with a list of its line items."""
    posting = F.struct(
        F.concat(F.lit("../p/"), F.col("l_linenumber").cast("string"), F.lit("?k="), F.col("l_partkey").cast("string")).alias("absolute_url"),
        F.col("l_partkey").alias("part"),
        F.col("l_returnflag").alias("flag"),
        (F.col("l_linestatus") == "O").alias("remote"),
        F.when(F.col("l_tax") > 0.02, F.array(F.struct(F.col("l_suppkey").alias("id"), F.col("l_linestatus").alias("name")), F.struct(F.col("l_suppkey").alias("id"), F.lit(None).cast("string").alias("name")))).alias("offices"),
    )
    lines = table(spark, sf, "lineitem").withColumn("posting", posting)
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("posting")).alias("jobs"))


@query("trim_budget")
def trim_budget(spark, sf):
    """Every order's listing cut to 900 characters (checked against brute force in tests)."""
    docs = listings(spark, sf).select("l_orderkey", F.to_json(F.struct("jobs")).alias("doc"))
    cut = docs.select("l_orderkey", learning.trim_to_budget(F.col("doc"), 900).alias("text"))
    return cut.withColumn("size", F.length("text"))


@query(
    "budget_refusals",
    """SELECT o_orderkey FROM orders WHERE length('{' || chr(10) || '  "note": "' || repeat(o_orderpriority, CAST(o_totalprice / 20000 AS INT)) || '",' || chr(10)
       || '  "tags": [' || chr(10) || '    "a"' || chr(10) || '  ]' || chr(10) || '}') > 120""",
)
def budget_refusals(spark, sf):
    """Documents with nothing left to drop that are still over the budget."""
    note = F.expr("repeat(o_orderpriority, cast(round(o_totalprice / 20000) as int))")
    doc = F.to_json(F.struct(note.alias("note"), F.array(F.lit("a")).alias("tags")))
    docs = table(spark, sf, "orders").select("o_orderkey", learning.trim_to_budget(doc, 120).alias("text"))
    return docs.filter(F.col("text").isNull()).select("o_orderkey")


def part_metadata(spark, sf):
    p = table(spark, sf, "part", spread=True)
    doc = F.to_json(
        F.struct(
            F.col("p_name").alias("title"),
            F.struct(
                F.when(F.col("p_size") > 5, F.col("p_type")).otherwise("").alias("level"),
                F.col("p_size").alias("Size"),
                F.when(F.col("p_size") > 40, F.concat(F.lit(" HTTPS://x.io/"), "p_brand")).otherwise(F.col("p_name")).alias("site"),
                F.when(F.col("p_size") > 20, F.array("p_brand", "p_type")).alias("tags"),
                F.struct(F.col("p_size").alias("n")).alias("deep"),
                (F.col("p_size") > 10).alias("flag"),
                F.array().cast("array<string>").alias("none"),
            ).alias("metadata"),
        ),
        {"ignoreNullFields": "false"},
    )
    return p.select("p_partkey", F.try_parse_json(doc).alias("row"))


@query(
    "metadata_text",
    """SELECT p_partkey, k AS label, v AS text FROM part, LATERAL (VALUES ('Level', CASE WHEN p_size > 5 THEN p_type END), ('Size', CAST(p_size AS VARCHAR)),
    ('Site', CASE WHEN p_size > 40 THEN ' HTTPS://x.io/' || p_brand ELSE p_name END), ('Tags', CASE WHEN p_size > 20 THEN p_brand || ', ' || p_type END)) AS t(k, v)
    WHERE v IS NOT NULL""",
)
def metadata_text(spark, sf):
    members = part_metadata(spark, sf).select("p_partkey", F.explode(D.entries(D.field(F.col("row"), "$.metadata"))).alias("k", "v"))
    shown = members.select("p_partkey", text.humanize_key(F.col("k")).alias("label"), D.metadata_text(F.col("v")).alias("text"))
    return shown.filter(F.col("text").isNotNull())


@query(
    "drop_empty",
    """SELECT p_partkey, '{"Size":' || p_size || ',"deep":{"n":' || p_size || '},"flag":' || (p_size > 10) || CASE WHEN p_size > 5 THEN ',"level":"' || p_type || '"' ELSE '' END
    || ',"site":"' || CASE WHEN p_size > 40 THEN ' HTTPS://x.io/' || p_brand ELSE p_name END || '"'
    || CASE WHEN p_size > 20 THEN ',"tags":["' || p_brand || '","' || p_type || '"]' ELSE '' END || '}' AS metadata FROM part""",
)
def drop_empty(spark, sf):
    cleaned = D.drop_empty(D.field(F.col("row"), "$.metadata"))
    return part_metadata(spark, sf).select("p_partkey", F.to_json(cleaned).alias("metadata"))
