"""Request dedup and leases over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanwork.operators import claims as C
from gleanwork.queries.registry import query, table

HOST = "'h' || (user_id % 10) || '.example.com'"


def requests(spark, sf):
    """Ten busy hosts asking for a rule, some pushes failing."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"), F.lit(".example.com")).alias("host"),
        "ts",
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "error").alias("push_failed"),
    )


DEDUP = f"""
WITH RECURSIVE q AS (SELECT {HOST} AS host, ts, event_id FROM events WHERE event_type <> 'error'),
g(host, ts) AS (
    SELECT host, min(ts) FROM q GROUP BY host
    UNION ALL
    SELECT g.host, (SELECT min(q.ts) FROM q WHERE q.host = g.host AND q.ts >= g.ts + INTERVAL 1800 SECOND) FROM g WHERE g.ts IS NOT NULL)
SELECT q.host, q.event_id AS seq FROM g JOIN q ON q.host = g.host AND q.ts = g.ts"""


@query("request_dedup", DEDUP)
def request_dedup(spark, sf):
    return C.request_dedup(requests(spark, sf)).select("host", "seq")


@query("request_dedup_chunked", DEDUP)
def request_dedup_chunked(spark, sf):
    """The same with every host busy enough to be cut into runs."""
    return C.request_dedup(requests(spark, sf), chunk_rows=300).select("host", "seq")


@query(
    "request_dedup_burst",
    """
WITH RECURSIVE q AS (SELECT date_trunc('hour', ts) AS ts, min(event_id) AS seq FROM events WHERE event_type <> 'error' GROUP BY 1),
g(ts) AS (
    SELECT min(ts) FROM q
    UNION ALL
    SELECT (SELECT min(q.ts) FROM q WHERE q.ts >= g.ts + INTERVAL 1800 SECOND) FROM g WHERE g.ts IS NOT NULL)
SELECT 'one' AS host, q.seq AS seq FROM g JOIN q ON q.ts = g.ts""",
)
def request_dedup_burst(spark, sf):
    """One host asks for everything, an hour's requests in one instant."""
    rows = requests(spark, sf).withColumn("host", F.lit("one")).withColumn("ts", F.date_trunc("hour", "ts"))
    return C.request_dedup(rows, chunk_rows=1000).select("host", "seq")


LEASES = """WITH RECURSIVE e AS (SELECT 'detail:u' || (user_id % 30) AS key, event_id, ts, event_type = 'purchase' AS release,
             row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, event_id) AS n
             FROM events),
    w(key, n, event_id, release, granted, held) AS (
        SELECT key, n, event_id, release, NOT release, CASE WHEN release THEN TIMESTAMP '1970-01-01' ELSE ts + INTERVAL 1800 SECOND END
        FROM e WHERE n = 1
        UNION ALL
        SELECT e.key, e.n, e.event_id, e.release, NOT e.release AND e.ts >= w.held,
               CASE WHEN e.release THEN TIMESTAMP '1970-01-01' WHEN e.ts >= w.held THEN e.ts + INTERVAL 1800 SECOND ELSE w.held END
        FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1)
    SELECT event_id AS seq, granted FROM w WHERE NOT release"""


def lease_tasks(spark, sf):
    """Every event tries to take its user group's lease, but for purchases, which release it."""
    return table(spark, sf, "events").select(
        F.lit("detail").alias("stage"),
        F.concat(F.lit("u"), (F.col("user_id") % 30).cast("string")).alias("domain"),
        F.when(F.col("event_type") == "purchase", C.RELEASE).otherwise(C.ACQUIRE).alias("kind"),
        "ts",
        F.col("event_id").alias("seq"),
    )


@query("lease_state", LEASES)
def lease_state(spark, sf):
    return C.lease_outcomes(lease_tasks(spark, sf)).select("seq", "granted")
