"""Streaming twins over `events`, checked by the SQL of the batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanwork import schemas
from gleanwork.operators import bronze as B
from gleanwork.operators import claims as C
from gleanwork.operators import rules as R
from gleanwork.operators.steps import written
from gleanwork.queries.bronze import MESSAGES, REGISTRY
from gleanwork.queries.bronze import raw_messages as message_rows
from gleanwork.queries.claims import DEDUP, LEASES, lease_tasks, requests
from gleanwork.queries.mapping import all_rules

from gleanwork.queries.registry import query, table
from gleanwork.session import shared_dir
from gleanwork.sources.messages import parse_messages
from gleanwork.sources.tables import append_events
from gleanwork.streaming import claims as K
from gleanwork.streaming import ingest as I


def fresh(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(spark, df, root: str, files: int) -> str:
    """The rows in folders, one for each range of `seq`."""
    path = f"{root}/input"
    low, high = df.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // files + 1
    for k in range(files):
        part = df.filter((F.col("seq") >= low + k * step) & (F.col("seq") < low + (k + 1) * step))
        part.write.parquet(f"{path}/part-{k}")
    return path


def ingested(spark, sf, rules=None):
    """All messages through the stream, in two micro-batches; with rules on to Silver."""
    root = fresh(spark, "ingest")
    rows = message_rows(spark, sf)
    path = staged(spark, rows, root, 2)
    tables = I.Tables.under(spark, root)
    if rules is not None:
        winners, _ = R.resolve_rules(R.rules_table(spark, rules))
    # The second folder comes after a restart: the stream finds what it has not yet read.
    for reached in ("{part-0}", "{part-0,part-1}"):
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/{reached}")
        started = I.start_bronze(stream, tables) if rules is None else I.start_ingest(stream, tables, rules, winners)
        started.awaitTermination()
    return tables


FEED_RULE = {
    "version": 1,
    "type": "detail",
    "domains": ["feed.example.com"],
    "fields": {
        "title": {"sql": "concat('Job ', try_variant_get(doc, '$.k', 'string'))"},
        "company_name": {"sql": "'Acme'"},
        "description": {"sql": "if(try_variant_get(doc, '$.k', 'int') < 50, 'A job.', '')"},
    },
}


STATE = """
l AS (SELECT url, arg_max(raw_content, seq) AS raw_content, arg_max(content_type, seq) AS content_type, arg_max(run_id, seq) AS run_id
      FROM ok WHERE content_type IS NOT NULL GROUP BY url),
n AS (SELECT url, min(seq) AS seq FROM ok GROUP BY url),
f AS (SELECT ok.url, ok.raw_content, ok.content_type, ok.run_id, ok.start_url_id FROM ok JOIN n ON n.seq = ok.seq),
a AS (SELECT url, arg_min(start_url_id, seq) FILTER (start_url_id IS NOT NULL AND content_type IS NOT NULL) AS attributed FROM ok GROUP BY url)"""


# A batch's cutoffs close what their runs saw last, in that batch or an earlier one.
CLOSED = f"""{REGISTRY}, bt AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // 2 + 1 AS step FROM events),
fs AS (SELECT id, (min(seq) - any_value(low)) // any_value(step) AS b FROM named, bt GROUP BY id),
rb AS (SELECT r.id, r.spider_name, r.started_at, fs.b FROM r JOIN fs ON fs.id = r.id),
en AS (SELECT DISTINCT rb.spider_name, (m.seq - low) // step AS b FROM m JOIN rb ON m.run_id = rb.id, bt WHERE m.broken IS NULL AND m.type = 'END_OF_RUN'),
cu AS (SELECT en.b, en.spider_name, list(rb.started_at ORDER BY rb.started_at DESC)[3] AS cutoff
       FROM en JOIN rb ON rb.spider_name = en.spider_name AND rb.b <= en.b GROUP BY 1, 2 HAVING count(*) >= 4)"""


@query(
    "stream_bronze",
    f"""WITH {MESSAGES}, {STATE}, {CLOSED}, g AS (SELECT url, max(seq) FILTER (content_type IS NOT NULL) AS newest, min(seq) AS oldest FROM ok GROUP BY url),
    o AS (SELECT f.url, coalesce(l.raw_content, f.raw_content) AS raw_content,
    CASE WHEN l.url IS NOT NULL THEN l.content_type ELSE coalesce(f.content_type, 'text/html') END AS content_type,
    coalesce(l.run_id, f.run_id) AS last_seen_run_id, coalesce(f.start_url_id, a.attributed) AS start_url_id, (coalesce(newest, oldest) - low) // step AS b
    FROM f JOIN g ON g.url = f.url LEFT JOIN l ON l.url = f.url LEFT JOIN a ON a.url = f.url, bt)
    SELECT url, raw_content, content_type, last_seen_run_id, start_url_id,
           EXISTS (SELECT 1 FROM rb JOIN cu ON cu.spider_name = rb.spider_name WHERE rb.id = o.last_seen_run_id AND cu.cutoff > rb.started_at AND cu.b >= o.b) AS deleted
    FROM o""",
)
def stream_bronze(spark, sf):
    rows = I.read_bronze(ingested(spark, sf))
    return rows.select("url", "raw_content", "content_type", "last_seen_run_id", "start_url_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("stream_runs", f"WITH {MESSAGES}, {REGISTRY} SELECT id, spider_name FROM r")
def stream_runs(spark, sf):
    return ingested(spark, sf).runs.read().select("id", "spider_name")


# What each batch brings to Silver: of a url the newest complete item of the batch, or the
# item without a type that made the row.
BATCHES = f"""{MESSAGES}, bt AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // 2 + 1 AS step FROM events),
okb AS (SELECT ok.*, (seq - low) // step AS b, min(seq) OVER (PARTITION BY url) AS made FROM ok, bt),
w AS (SELECT url, b, max(seq) FILTER (content_type IS NOT NULL) AS newest, min(made) FILTER (seq = made) AS made FROM okb GROUP BY url, b),
ch AS (SELECT w.url, w.b, okb.raw_content AS body, coalesce(okb.content_type, 'text/html') AS content_type
       FROM w JOIN okb ON okb.seq = coalesce(w.newest, w.made))"""


@query(
    "stream_refusals",
    f"""WITH {BATCHES}, {STATE}
    SELECT ch.url AS posting_url, 'feed.example.com' AS domain, 'detail' AS stage, 'no_rule' AS reason, coalesce(f.start_url_id, a.attributed) AS start_url_id
    FROM ch JOIN f ON f.url = ch.url LEFT JOIN a ON a.url = ch.url WHERE ch.content_type = 'application/json'""",
)
def stream_refusals(spark, sf):
    """No rule serves the stream's feed, so every JSON row is refused, once a batch."""
    log = I.read_events(ingested(spark, sf, rules=all_rules(spark)[0]))
    return log.select("posting_url", "domain", "stage", "reason", "start_url_id")


@query(
    "stream_silver",
    f"""WITH {BATCHES}, ac AS (SELECT url, b, body FROM ch WHERE content_type = 'application/json' AND CAST(json_extract_string(body, '$.k') AS INTEGER) < 50)
    SELECT url, 'Job ' || json_extract_string(arg_max(body, b), '$.k') AS title, 'Acme' AS company_name, 'A job.' AS description FROM ac GROUP BY url""",
)
def stream_silver(spark, sf):
    """The same feed with a rule: typed rows, the last accepted one of each url."""
    tables = ingested(spark, sf, rules=[R.parse_rule(FEED_RULE)])
    return tables.silver.read().select("url", "title", "company_name", "description")


def in_restarts(spark, rows, files: int, name: str, ttl: int):
    """The rows as so many micro-batches, the stream stopped and started again before each."""
    root = fresh(spark, name)
    low, high = rows.agg(F.min("seq"), F.max("seq")).first()
    step = (high - low) // files + 1
    for k in range(files):
        part = rows.filter((F.col("seq") >= low + k * step) & (F.col("seq") < low + (k + 1) * step))
        part.write.mode("append").parquet(f"{root}/input")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/input")
        K.start_claims(stream, root, ttl).awaitTermination()
    return spark.read.schema(K.JUDGED).parquet(f"{root}/judged")


@query("stream_request_dedup", DEDUP)
def stream_request_dedup(spark, sf):
    """The dedup fed in three micro-batches with a restart between, its holds in the state."""
    rows = K.request_events(requests(spark, sf).filter(~F.col("push_failed")))
    judged = in_restarts(spark, rows, 3, "dedup", C.REQUEST_TTL_SECONDS)
    return judged.filter("granted").select(F.col("key").alias("host"), "seq")


@query("stream_lease_state", LEASES)
def stream_lease_state(spark, sf):
    """The leases fed in three micro-batches with a restart between."""
    return in_restarts(spark, K.lease_events(lease_tasks(spark, sf)), 3, "leases", C.LEASE_TTL_SECONDS).select("seq", "granted")


@query("event_log", "SELECT event_type AS reason, count(*) AS count FROM events GROUP BY event_type")
def event_log(spark, sf):
    """Refusal events appended to a log and read back."""
    path = fresh(spark, "events")
    e = table(spark, sf, "events")
    none = F.lit(None).cast("string")
    events = e.select(
        F.col("ts").alias("occurred_at"), F.lit("h.example.com").alias("domain"), none.alias("start_url_id"),
        F.lit("https://h.example.com/").alias("source_url"), none.alias("posting_url"), F.lit("detail").alias("stage"),
        F.col("event_type").alias("reason"), none.alias("detail"),
    )
    append_events(events, path)
    log = spark.read.schema(schemas.INGEST_EVENTS).parquet(path)
    return log.groupBy("reason").agg(F.count_distinct("id").alias("count"))


@query(
    "keyed_table",
    f"""WITH {MESSAGES}, {STATE} SELECT f.url, coalesce(l.raw_content, f.raw_content) AS raw_content,
    CASE WHEN l.url IS NOT NULL THEN l.content_type ELSE coalesce(f.content_type, 'text/html') END AS content_type,
    coalesce(f.start_url_id, a.attributed) AS start_url_id FROM f LEFT JOIN l ON l.url = f.url LEFT JOIN a ON a.url = f.url""",
)
def keyed_table(spark, sf):
    """The messages in four parts, put out of order and one of them twice, two of them compacted."""
    table = I.Tables.under(spark, fresh(spark, "table")).bronze
    messages = written(parse_messages(message_rows(spark, sf))[0])
    for part in (1, 0, 3, 0, 2):
        some = messages.filter(F.col("seq") % 4 == part)
        table.put(B.fold_items(some, F.current_timestamp(), part), part)
        if part == 3:
            table.compact(1)
    return table.read().select("url", "raw_content", "content_type", "start_url_id")
