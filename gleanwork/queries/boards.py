"""Boards made of `supplier` and `orders`, with Bronze and Silver made of `lineitem`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from gleanwork.operators import backfill as K
from gleanwork.operators import boards as B
from gleanwork.queries.registry import query, table

NOW = datetime(2024, 2, 1)


def supplier_boards(spark, sf):
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    return s.select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        F.concat(
            F.lit("https://b"), F.col("s_nationkey").cast("string"),
            F.lit(".example.com/jobs?filter.team[]="), key, F.lit("&per=50&%66ilter.on=1#list"),
        ).alias("url"),
        F.when(F.col("s_acctbal") < 0, "legacy").when(F.col("s_nationkey") < 12, "api").otherwise("html_crawl").alias("type"),
        (F.col("s_acctbal") < 8000).alias("active"),
        F.lit(datetime(2023, 1, 1)).alias("created_at"),
        F.lit(datetime(2023, 1, 1)).alias("updated_at"),
    )


SUPPLIERS = """
b AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name,
             'https://b' || s_nationkey || '.example.com/jobs?filter.team[]=' || s_suppkey || '&per=50&%66ilter.on=1#list' AS url,
             CASE WHEN s_acctbal < 0 THEN 'legacy' WHEN s_nationkey < 12 THEN 'api' ELSE 'html_crawl' END AS type,
             s_acctbal < 8000 AS active, s_nationkey FROM supplier)"""


@query("active_boards", f"WITH {SUPPLIERS} SELECT id, name, type FROM b WHERE active AND type <> 'legacy'")
def active_boards(spark, sf):
    return B.active_boards(supplier_boards(spark, sf)).select("id", "name", "type")


@query(
    "active_board_counts",
    f"""WITH {SUPPLIERS}, c AS (SELECT count(*) AS configured, count(*) FILTER (active AND type <> 'legacy') AS active FROM b)
    SELECT configured, active, active = 0 AS nothing_to_do FROM c""",
)
def active_board_counts(spark, sf):
    return B.active_board_counts(supplier_boards(spark, sf))


@query(
    "plan_requests",
    f"""WITH {SUPPLIERS} SELECT id AS start_url_id, url AS stored_url, type, CASE WHEN type = 'api'
    THEN 'https://b' || s_nationkey || '.example.com/jobs?per=50#list' ELSE url END AS request_url
    FROM b WHERE active AND type <> 'legacy'""",
)
def plan_requests(spark, sf):
    return B.plan_requests(B.active_boards(supplier_boards(spark, sf)))


def order_boards(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")


def line_bronze(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.select(
        F.concat_ws("/", F.lit("https://jobs.example.com"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("url"),
        F.when(F.col("l_linestatus") == "O", F.col("l_orderkey").cast("string")).alias("start_url_id"),
        F.when(F.col("l_tax") > 0.07, F.col("l_shipdate")).alias("deleted_at"),
        F.when(F.col("l_discount") > 0.05, "application/json").otherwise("text/html").alias("content_type"),
        F.concat(F.lit("https://feed"), F.col("l_suppkey").cast("string"), F.lit(".example.com/v1")).alias("source_url"),
        "l_returnflag", "l_quantity", "l_shipdate",
    )


def line_silver(spark, sf):
    return line_bronze(spark, sf).filter(F.col("l_returnflag") != "R").select(
        "url",
        F.md5("url").alias("id"),
        F.when(F.col("l_quantity") > 40, F.col("l_shipdate")).alias("deleted_at"),
    )


LINES = """
br AS (SELECT concat_ws('/', 'https://jobs.example.com', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS url,
              CASE WHEN l_linestatus = 'O' THEN CAST(l_orderkey AS VARCHAR) END AS start_url_id, l_tax > 0.07 AS deleted,
              l_discount > 0.05 AS mapped, l_suppkey, l_returnflag, l_quantity, l_shipdate FROM lineitem),
si AS (SELECT DISTINCT url, md5(url) AS id, l_quantity > 40 AS deleted FROM br WHERE l_returnflag <> 'R')"""


@query(
    "board_counts",
    f"""WITH {LINES}, raw AS (SELECT start_url_id, count(*) AS n FROM br WHERE start_url_id IS NOT NULL GROUP BY 1),
    live AS (SELECT br.start_url_id, count(DISTINCT si.id) AS n FROM br JOIN si ON br.url = si.url AND NOT si.deleted
             WHERE start_url_id IS NOT NULL GROUP BY 1)
    SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN raw.n IS NOT NULL THEN coalesce(live.n, 0) END AS posting_count
    FROM orders LEFT JOIN raw ON raw.start_url_id = CAST(o_orderkey AS VARCHAR) LEFT JOIN live ON live.start_url_id = CAST(o_orderkey AS VARCHAR)""",
)
def board_counts(spark, sf):
    counted = B.board_posting_counts(order_boards(spark, sf), line_bronze(spark, sf), line_silver(spark, sf))
    return counted.select("id", "posting_count")


def candidates(spark, sf):
    """Suppliers proposing names and addresses some of which others hold."""
    s = table(spark, sf, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("Supplier#"), F.lpad((F.col("s_suppkey") % 40).cast("string"), 9, "0")))
        .otherwise(F.col("s_name")).alias("name"),
        F.when(F.col("s_acctbal") < 0, F.concat(F.lit("https://x/"), (F.col("s_suppkey") % 7).cast("string")))
        .otherwise(F.concat(F.lit("https://x/"), F.col("s_suppkey").cast("string"))).alias("url"),
    )


CANDIDATES = """
held AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'https://x/' || s_suppkey AS url FROM supplier),
ca AS (SELECT CAST(s_suppkey AS VARCHAR) AS id,
              CASE WHEN s_acctbal > 5000 THEN 'Supplier#' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 9, '0') ELSE s_name END AS name,
              CASE WHEN s_acctbal < 0 THEN 'https://x/' || (s_suppkey % 7) ELSE 'https://x/' || s_suppkey END AS url FROM supplier)"""


def held(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("https://x/"), F.col("s_suppkey").cast("string")).alias("url"),
    )


@query(
    "board_conflicts",
    f"""WITH {CANDIDATES} SELECT id, name, url FROM ca WHERE EXISTS
    (SELECT 1 FROM held WHERE (held.name = ca.name OR held.url = ca.url) AND held.id <> ca.id)""",
)
def board_conflicts(spark, sf):
    return B.conflicting_boards(candidates(spark, sf), held(spark, sf))


@query("board_duplicates", f"WITH {CANDIDATES} SELECT name, count(*) AS count FROM ca GROUP BY name HAVING count(*) > 1")
def board_duplicates(spark, sf):
    return B.duplicate_keys(candidates(spark, sf), "name")


def board_changes_input(spark, sf):
    """Every supplier sends one change to the boards of the first sixty nation slots."""
    s = table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    boards = s.filter(F.col("s_nationkey") < 15).select(
        key.alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("https://x/"), key).alias("url"),
        F.lit("api").alias("type"), (F.col("s_acctbal") > 0).alias("active"),
        F.lit(datetime(2023, 1, 1)).alias("created_at"), F.lit(datetime(2023, 1, 1)).alias("updated_at"),
    )
    op = F.when(F.col("s_acctbal") > 7000, "delete").when(F.col("s_nationkey") < 18, "update").otherwise("create")
    first = s.select(
        F.col("s_suppkey").alias("seq"), op.alias("op"), key.alias("id"),
        F.when(F.col("s_acctbal") < 0, F.concat(F.lit("Renamed "), (F.col("s_suppkey") % 5).cast("string")))
        .when(F.col("s_acctbal") < 500, F.lit("  ")).otherwise(F.col("s_name")).alias("name"),
        F.concat(F.lit("https://x/"), key).alias("url"),
        F.when(F.col("s_acctbal") > 5000, "html_crawl").otherwise("api").alias("type"),
        F.lit(True).alias("active"),
    )
    again = s.filter(F.col("s_suppkey") % 2 == 0).select(
        (F.col("s_suppkey") + 1000000).alias("seq"), F.lit("create").alias("op"), F.concat(F.lit("n"), key).alias("id"),
        F.col("s_name").alias("name"), F.concat(F.lit("https://y/"), key).alias("url"), F.lit("api").alias("type"), F.lit(True).alias("active"),
    )
    last = s.filter(F.col("s_suppkey") % 3 == 0).select(
        (F.col("s_suppkey") + 2000000).alias("seq"),
        F.when(F.col("s_suppkey") % 4 == 0, "delete").otherwise("update").alias("op"), key.alias("id"),
        F.concat(F.lit("Renamed "), (F.col("s_suppkey") % 7).cast("string")).alias("name"),
        F.concat(F.lit("https://z/"), key).alias("url"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("active"),
    )
    return boards, first.unionByName(again).unionByName(last)


# The changes one after the other: a list of boards is carried from each to the next.
CHANGES = """
bo AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'https://x/' || s_suppkey AS url, s_acctbal > 0 AS active
       FROM supplier WHERE s_nationkey < 15),
ch AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM (
       SELECT s_suppkey AS seq, CASE WHEN s_acctbal > 7000 THEN 'delete' WHEN s_nationkey < 18 THEN 'update' ELSE 'create' END AS op,
              CAST(s_suppkey AS VARCHAR) AS id,
              CASE WHEN s_acctbal < 0 THEN 'Renamed ' || (s_suppkey % 5) WHEN s_acctbal < 500 THEN '  ' ELSE s_name END AS name,
              'https://x/' || s_suppkey AS url, CASE WHEN s_acctbal > 5000 THEN 'html_crawl' ELSE 'api' END AS type, true AS active FROM supplier
       UNION ALL SELECT s_suppkey + 1000000, 'create', 'n' || s_suppkey, s_name, 'https://y/' || s_suppkey, 'api', true FROM supplier WHERE s_suppkey % 2 = 0
       UNION ALL SELECT s_suppkey + 2000000, CASE WHEN s_suppkey % 4 = 0 THEN 'delete' ELSE 'update' END, CAST(s_suppkey AS VARCHAR),
                        'Renamed ' || (s_suppkey % 7), 'https://z/' || s_suppkey, NULL, false FROM supplier WHERE s_suppkey % 3 = 0)),
st AS (
  SELECT CAST(0 AS BIGINT) AS n, (SELECT list({'id': id, 'name': name, 'url': url, 'type': 'api', 'active': active, 'changed': '2023'}) FROM bo) AS bs,
         CAST(NULL AS VARCHAR) AS refusal
  UNION ALL
  SELECT x.n, CASE WHEN x.refusal IS NOT NULL THEN x.bs WHEN x.op = 'delete' THEN x.others
              ELSE list_append(x.others, {'id': x.id, 'name': x.name, 'url': x.url, 'type': coalesce(x.held[1].type, x.type), 'active': x.active, 'changed': '2024'}) END,
         x.refusal
  FROM (SELECT y.*, CASE
          WHEN op = 'create' AND type NOT IN ('api', 'html_crawl') THEN 'unknown_type'
          WHEN op <> 'delete' AND trim(name) = '' THEN 'blank'
          WHEN op <> 'create' AND len(held) = 0 THEN 'not_found'
          WHEN op = 'update' AND type <> held[1].type THEN 'type_is_fixed'
          WHEN op <> 'delete' AND (len([b for b in others if b.name = y.name OR b.url = y.url]) > 0 OR (op = 'create' AND len(held) > 0)) THEN 'duplicate' END AS refusal
        FROM (SELECT ch.*, st.bs, [b for b in st.bs if b.id <> ch.id] AS others, [b for b in st.bs if b.id = ch.id] AS held
              FROM st JOIN ch ON ch.n = st.n + 1) y) x
)"""


@query(
    "board_changes_refused",
    f"WITH RECURSIVE {CHANGES} SELECT seq, op, id, name, url, refusal FROM st JOIN ch USING (n) WHERE refusal IS NOT NULL",
)
def board_changes_refused(spark, sf):
    boards, changes = board_changes_input(spark, sf)
    return B.apply_board_changes(boards, changes, F.lit(NOW))[1]


@query(
    "board_changes",
    f"""WITH RECURSIVE {CHANGES} SELECT b.id AS id, b.name AS name, b.url AS url, b.type AS type, b.active AS active, b.changed AS changed
    FROM (SELECT unnest(bs) AS b FROM st WHERE n = (SELECT max(n) FROM st))""",
)
def board_changes(spark, sf):
    boards, changes = board_changes_input(spark, sf)
    merged = B.apply_board_changes(boards, changes, F.lit(NOW))[0]
    return merged.select("id", "name", "url", "type", "active", F.date_format("updated_at", "yyyy").alias("changed"))


@query(
    "board_detached",
    f"""WITH {LINES} SELECT url, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE start_url_id END AS start_url_id
    FROM br LEFT JOIN orders ON start_url_id = CAST(o_orderkey AS VARCHAR)""",
)
def board_detached(spark, sf):
    gone = order_boards(spark, sf).filter(F.col("o_orderstatus") == "F")
    return B.detach_deleted_boards(line_bronze(spark, sf), gone, ["url"]).select("url", "start_url_id")


@query("backfill_candidates", f"WITH {LINES} SELECT url FROM br WHERE NOT deleted AND url NOT IN (SELECT url FROM si)")
def backfill_candidates(spark, sf):
    return K.backfill_candidates(line_bronze(spark, sf), line_silver(spark, sf)).select("url")


def host_rules(spark, sf):
    """Page rules for the public host of some suppliers, mapping rules for some feeds."""
    s = table(spark, sf, "supplier")
    feed = F.concat(F.lit("feed"), F.col("s_suppkey").cast("string"), F.lit(".example.com"))
    return s.filter(F.col("s_acctbal") > 3000).select(
        F.lit("detail").alias("kind"), feed.alias("domain"), F.lit(0).alias("rule_id")
    ).unionByName(
        table(spark, sf, "region").filter(F.col("r_regionkey") == 0).select(
            F.lit("extraction").alias("kind"), F.lit("jobs.example.com").alias("domain"), F.lit(1).alias("rule_id")
        )
    )


@query(
    "backfill_summary",
    f"""WITH {LINES}, c AS (SELECT *, CASE WHEN mapped THEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 3000) ELSE true END AS ruled
    FROM br WHERE NOT deleted AND url NOT IN (SELECT url FROM si))
    SELECT count(*) AS matched, count(*) FILTER (NOT ruled) AS skipped_no_rule, count(*) FILTER (ruled) AS enqueued FROM c""",
)
def backfill_summary(spark, sf):
    waiting = K.backfill_candidates(line_bronze(spark, sf), line_silver(spark, sf))
    return K.backfill_summary(K.backfill_state(waiting, host_rules(spark, sf), ("extraction", "detail")))


@query(
    "backfill_page_rules",
    f"""WITH {LINES} SELECT count(*) AS matched, 0 AS skipped_no_rule, count(*) AS enqueued
    FROM br WHERE NOT deleted AND url NOT IN (SELECT url FROM si)""",
)
def backfill_page_rules(spark, sf):
    """The default: only page rules count, looked up by the posting's own address."""
    waiting = K.backfill_candidates(line_bronze(spark, sf), line_silver(spark, sf))
    return K.backfill_summary(K.backfill_state(waiting, host_rules(spark, sf)))


