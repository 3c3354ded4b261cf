"""Crawl messages made of `events`, over a Bronze table made of `customer`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanwork.operators import bronze as B
from gleanwork.queries.registry import as_uuid, query, sql_text, table, text, uuid_text
from gleanwork.sources.messages import parse_messages

NOW = datetime(2024, 2, 1)


def raw_messages(spark, sf):
    """Events as JSON messages: items, run starts and ends, and some that are broken."""
    e = table(spark, sf, "events", spread=True)
    day = F.date_format("ts", "yyyy-MM-dd")
    user = F.col("user_id").cast("string")
    url = F.concat(F.lit("https://jobs.example.com/"), F.when(F.col("event_type") == "error", "e/").otherwise("c/"), user)
    item = F.struct(
        F.when(F.col("value") >= 1, url).alias("url"),
        F.when(F.col("value") >= 2, F.col("props")).alias("raw_content"),
        F.when(F.col("event_type") != "click", F.lit("application/json")).alias("content_type"),
        F.concat(F.lit("https://feed.example.com/"), "event_type").alias("source_url"),
        F.when(F.col("event_type") == "signup", F.md5(F.concat(F.lit("b"), user)))
        .when(F.col("event_type") == "purchase", F.lit("not-an-id")).alias("start_url_id"),
        F.struct(F.when(F.col("event_type") != "view", F.col("event_type")).alias("spider"), user.alias("user")).alias("metadata"),
    )
    type_ = (
        F.when((F.col("event_type") == "view") & (F.col("value") > 90), "START_RUN")
        .when((F.col("event_type") == "error") & (F.col("value") > 90), "END_OF_RUN")
        .when((F.col("event_type") == "click") & (F.col("value") > 95), "PING")
        .otherwise("ITEM")
    )
    run = F.when(F.col("value") < 0.5, F.lit("no-run")).otherwise(F.md5(F.concat("event_type", day)))
    value = F.to_json(
        F.struct(
            type_.alias("type"),
            run.alias("run_id"),
            F.when(type_ != "ITEM", F.concat(F.lit("spider-"), "event_type")).alias("spider_name"),
            (F.unix_micros("ts") / 1000000).alias("timestamp"),
            F.when(type_ == "ITEM", item).alias("item"),
        )
    )
    broken = (F.col("event_type") == "purchase") & (F.col("value") > 97)
    return e.select(F.col("event_id").alias("seq"), F.when(broken, F.concat(F.lit("{"), value)).otherwise(value).alias("value"))


MESSAGES = f"""
m AS (SELECT event_id AS seq, ts, event_type, value, user_id, props,
        CASE WHEN event_type = 'purchase' AND value > 97 THEN 'malformed'
             WHEN event_type = 'click' AND value > 95 THEN 'unknown_type' END AS broken,
        CASE WHEN event_type = 'view' AND value > 90 THEN 'START_RUN' WHEN event_type = 'error' AND value > 90 THEN 'END_OF_RUN' ELSE 'ITEM' END AS type,
        CASE WHEN value >= 0.5 THEN {as_uuid("md5(event_type || strftime(ts, '%Y-%m-%d'))")} END AS run_id,
        CASE WHEN value >= 1 THEN 'https://jobs.example.com/' || CASE WHEN event_type = 'error' THEN 'e/' ELSE 'c/' END || user_id END AS url,
        CASE WHEN value >= 2 THEN props END AS raw_content,
        CASE WHEN event_type <> 'click' THEN 'application/json' END AS content_type,
        'https://feed.example.com/' || event_type AS source_url,
        CASE WHEN event_type = 'signup' THEN {as_uuid("md5('b' || user_id)")} END AS start_url_id
      FROM events),
i AS (SELECT * FROM m WHERE broken IS NULL AND type = 'ITEM'),
ok AS (SELECT * FROM i WHERE run_id IS NOT NULL AND url IS NOT NULL AND raw_content IS NOT NULL)"""


def messages(spark, sf):
    return parse_messages(raw_messages(spark, sf))[0]


def bronze(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    return c.select(
        F.concat(F.lit("https://jobs.example.com/c/"), key).alias("url"),
        F.col("c_name").alias("raw_content"),
        F.lit("text/html").alias("content_type"),
        F.concat(F.lit("https://jobs.example.com/c/"), key).alias("source_url"),
        F.to_variant_object(F.struct(F.col("c_mktsegment").alias("spider"))).alias("metadata"),
        uuid_text(F.md5(F.concat(F.lit("run"), (F.col("c_nationkey") % 6).cast("string")))).alias("last_seen_run_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", uuid_text(F.md5(F.concat(F.lit("old"), key)))).alias("start_url_id"),
        F.lit(datetime(2023, 1, 1)).alias("created_at"),
        F.lit(datetime(2023, 1, 1)).alias("updated_at"),
        F.when(F.col("c_acctbal") < 0, F.lit(datetime(2023, 6, 1))).alias("deleted_at"),
    )


BRONZE = f"""
b AS (SELECT 'https://jobs.example.com/c/' || c_custkey AS url, c_name AS raw_content, 'text/html' AS content_type,
             'https://jobs.example.com/c/' || c_custkey AS source_url, c_mktsegment AS spider,
             {as_uuid("md5('run' || (c_nationkey % 6))")} AS last_seen_run_id,
             CASE WHEN c_mktsegment = 'BUILDING' THEN {as_uuid("md5('old' || c_custkey)")} END AS start_url_id,
             TIMESTAMP '2023-01-01' AS created_at, TIMESTAMP '2023-01-01' AS updated_at,
             CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2023-06-01' END AS deleted_at FROM customer)"""

UPSERT = f"""
l AS (SELECT url, max(seq) AS seq FROM ok WHERE content_type IS NOT NULL GROUP BY url),
f AS (SELECT url, min(seq) AS seq FROM ok GROUP BY url),
a AS (SELECT url, arg_min(start_url_id, seq) FILTER (start_url_id IS NOT NULL AND content_type IS NOT NULL) AS attributed FROM ok GROUP BY url),
n AS (SELECT f.url, l.seq AS last_seq, f.seq AS first_seq, CASE WHEN l.seq IS NOT NULL THEN l.seq WHEN b.url IS NULL THEN f.seq END AS seq
      FROM f LEFT JOIN l ON l.url = f.url LEFT JOIN b ON b.url = f.url),
u AS (SELECT coalesce(b.url, n.url) AS url, n.seq IS NOT NULL AS touched,
        CASE WHEN n.seq IS NULL THEN b.raw_content ELSE ok.raw_content END AS raw_content,
        CASE WHEN n.seq IS NULL THEN b.content_type ELSE coalesce(ok.content_type, 'text/html') END AS content_type,
        CASE WHEN n.seq IS NULL THEN b.source_url ELSE ok.source_url END AS source_url,
        CASE WHEN n.seq IS NULL THEN b.spider WHEN ok.event_type = 'view' THEN NULL ELSE ok.event_type END AS spider,
        CASE WHEN n.seq IS NULL THEN b.last_seen_run_id ELSE ok.run_id END AS last_seen_run_id,
        CASE WHEN n.seq IS NULL OR b.start_url_id IS NOT NULL THEN b.start_url_id WHEN b.url IS NULL
             THEN coalesce((SELECT o.start_url_id FROM ok AS o WHERE o.seq = n.first_seq), a.attributed) ELSE a.attributed END AS start_url_id,
        coalesce(b.created_at, TIMESTAMP '2024-02-01') AS created_at,
        CASE WHEN n.seq IS NULL THEN b.updated_at ELSE TIMESTAMP '2024-02-01' END AS updated_at,
        CASE WHEN n.seq IS NULL THEN b.deleted_at END AS deleted_at
      FROM b FULL JOIN n ON b.url = n.url LEFT JOIN ok ON ok.seq = n.seq LEFT JOIN a ON a.url = n.url)"""
BRONZE_SQL = f"""url, raw_content, content_type, source_url, spider, last_seen_run_id, start_url_id,
    {sql_text('created_at')} AS created_at, {sql_text('updated_at')} AS updated_at, {sql_text('deleted_at')} AS deleted_at"""


def shown(df):
    return df.select(
        "url", "raw_content", "content_type", "source_url",
        F.try_variant_get("metadata", "$.spider", "string").alias("spider"), "last_seen_run_id", "start_url_id",
        *[text(F.col(c)).alias(c) for c in ("created_at", "updated_at", "deleted_at")],
    )


@query(
    "parse_messages",
    f"""WITH {MESSAGES} SELECT seq, type, CASE WHEN value < 0.5 THEN 'no-run' ELSE replace(run_id, '-', '') END AS run_id,
    CASE WHEN type = 'ITEM' THEN url END AS url, {sql_text('ts')} AS ts FROM m WHERE broken IS NULL""",
)
def parsed(spark, sf):
    return messages(spark, sf).select("seq", "type", "run_id", F.col("item.url").alias("url"), text(F.col("ts")).alias("ts"))


@query("message_rejects", f"WITH {MESSAGES} SELECT seq, broken AS reason FROM m WHERE broken IS NOT NULL")
def message_rejects(spark, sf):
    return parse_messages(raw_messages(spark, sf))[1].select("seq", "reason")


@query("bronze_upsert", f"WITH {MESSAGES}, {BRONZE}, {UPSERT} SELECT {BRONZE_SQL} FROM u")
def bronze_upsert(spark, sf):
    return shown(B.bronze_upsert(bronze(spark, sf), messages(spark, sf), F.lit(NOW)))


@query(
    "bronze_rejects",
    f"""WITH {MESSAGES}, {BRONZE} SELECT seq, url, CASE WHEN run_id IS NULL THEN 'bad_run_id' WHEN url IS NULL THEN 'no_url' ELSE 'no_raw_content' END AS reason
    FROM i WHERE run_id IS NULL OR url IS NULL OR raw_content IS NULL
    UNION ALL SELECT seq, url, 'no_content_type' FROM ok WHERE content_type IS NULL AND NOT
    (url NOT IN (SELECT url FROM b) AND seq = (SELECT min(seq) FROM ok AS o WHERE o.url = ok.url))""",
)
def bronze_rejects(spark, sf):
    return B.bronze_rejects(bronze(spark, sf), messages(spark, sf))


@query("changed_urls", f"WITH {MESSAGES} SELECT DISTINCT url FROM ok")
def changed_urls(spark, sf):
    return B.changed_urls(messages(spark, sf))


REGISTRY = """
named AS (SELECT run_id AS id, seq, ts, CASE WHEN type = 'ITEM' THEN CASE WHEN event_type = 'view' THEN 'unknown' ELSE event_type END
                 ELSE 'spider-' || event_type END AS spider_name FROM m WHERE broken IS NULL AND run_id IS NOT NULL),
r AS (SELECT id, arg_min(spider_name, seq) AS spider_name, arg_min(ts, seq) AS started_at FROM named GROUP BY id)"""


@query("run_registry", f"WITH {MESSAGES}, {REGISTRY} SELECT id, spider_name, {sql_text('started_at')} AS started_at FROM r")
def run_registry(spark, sf):
    return B.run_registry(messages(spark, sf)).select("id", "spider_name", text(F.col("started_at")).alias("started_at"))


@query(
    "run_outcome",
    """WITH c AS (SELECT md5(event_type || strftime(ts, '%Y-%m-%d')) AS run_id, count(*) FILTER (value <= 60) AS items,
                         count(*) FILTER (value > 97) AS errors FROM events GROUP BY 1)
    SELECT run_id, CASE WHEN items = 0 OR errors > 0 THEN 1 ELSE 0 END AS exit_code,
           CASE WHEN items = 0 THEN 'no items scraped' WHEN errors > 0 THEN errors || ' error(s) logged' ELSE 'ok' END AS reason FROM c""",
)
def run_outcome(spark, sf):
    log = table(spark, sf, "events").select(
        F.md5(F.concat("event_type", F.date_format("ts", "yyyy-MM-dd"))).alias("run_id"),
        F.when(F.col("value") <= 60, "item").when(F.col("value") > 97, "error").otherwise("note").alias("kind"),
    )
    return B.run_outcome(log).withColumn("exit_code", F.col("exit_code").cast("bigint"))


def seen(spark, sf):
    """Per user and type the last day it was seen on, as Bronze; runs are type and day."""
    e = table(spark, sf, "events")
    day = F.date_trunc("day", "ts")
    run = uuid_text(F.md5(F.concat("event_type", F.date_format("ts", "yyyy-MM-dd"))))
    runs = e.select(run.alias("id"), F.col("event_type").alias("spider_name"), day.alias("started_at")).distinct()
    rows = (
        e.groupBy("event_type", "user_id")
        .agg(F.max(F.struct(day.alias("day"), run.alias("run"))).alias("last"), F.max("value").alias("top"))
        .select(
            F.concat_ws("/", F.lit("https://jobs.example.com"), "event_type", "user_id").alias("url"),
            F.when(F.col("top") < 99, F.col("last.run")).alias("last_seen_run_id"),
            F.when(F.col("top") < 90, F.lit(datetime(2024, 1, 5))).alias("deleted_at"),
        )
    )
    return rows, runs


SEEN = """
runs AS (SELECT DISTINCT event_type AS spider, date_trunc('day', ts) AS started FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY spider ORDER BY started DESC) AS n FROM runs),
cut AS (SELECT spider, max(CASE WHEN n = 3 THEN started END) AS cutoff FROM ranked GROUP BY spider HAVING count(*) >= 4),
s AS (SELECT event_type, user_id, max(date_trunc('day', ts)) AS last, max(value) AS top FROM events GROUP BY 1, 2)"""


@query("spider_cutoffs", f"WITH {SEEN} SELECT spider AS spider_name, {sql_text('cutoff')} AS cutoff FROM cut")
def spider_cutoffs(spark, sf):
    return B.spider_cutoffs(seen(spark, sf)[1]).select("spider_name", text(F.col("cutoff")).alias("cutoff"))


@query(
    "tombstone",
    f"""WITH {SEEN} SELECT concat_ws('/', 'https://jobs.example.com', event_type, user_id) AS url,
    CASE WHEN top < 90 THEN '2024-01-05' WHEN top < 99 AND event_type <> 'click' AND last < cutoff THEN '2024-02-01' END AS closed
    FROM s LEFT JOIN cut ON cut.spider = s.event_type""",
)
def tombstone(spark, sf):
    """Every spider but one has ended a run; rows of the other stay open."""
    rows, runs = seen(spark, sf)
    ended = runs.filter(F.col("spider_name") != "click").select("spider_name").distinct()
    marked = B.tombstone(rows, runs, F.lit(NOW), ended)
    return marked.select("url", F.date_format("deleted_at", "yyyy-MM-dd").alias("closed"))


@query(
    "revive",
    f"WITH {MESSAGES}, {BRONZE}, {UPSERT} SELECT u.url FROM u JOIN b ON b.url = u.url WHERE b.deleted_at IS NOT NULL AND u.deleted_at IS NULL",
)
def revive(spark, sf):
    before = bronze(spark, sf)
    after = B.bronze_upsert(before, messages(spark, sf), F.lit(NOW)).filter(F.col("deleted_at").isNull())
    return before.filter(F.col("deleted_at").isNotNull()).join(after, "url", "left_semi").select("url")
