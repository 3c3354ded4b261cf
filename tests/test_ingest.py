import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanwork import schemas
from gleanwork.operators import bronze as B
from gleanwork.operators import filters as P
from gleanwork.operators import mapping as M
from gleanwork.operators import rules as R
from gleanwork.operators import silver as S
from gleanwork.plans.ingest import ingest_api
from gleanwork.queries.mapping import SHIPPED
from gleanwork.sources.messages import parse_messages
from gleanwork.streaming import ingest as I

NOW = datetime(2026, 2, 1)
RUN = "11111111-1111-1111-1111-111111111111"
BOARD = "22222222-2222-2222-2222-222222222222"


def item(url="https://a.io/1", run=RUN, kind="ITEM", **changes):
    body = {"url": url, "raw_content": "x", "content_type": "text/html", "source_url": url, "start_url_id": None, "metadata": {}}
    body.update(changes)
    return json.dumps({"type": kind, "run_id": run, "item": {k: v for k, v in body.items() if v != "drop"}})


@pytest.fixture
def upsert(spark):
    def run(messages, bronze=None):
        raw = spark.createDataFrame(list(enumerate(messages)), "seq bigint, value string")
        parsed, _ = parse_messages(raw)
        table = schemas.empty(spark, schemas.BRONZE) if bronze is None else bronze
        return B.bronze_upsert(table, parsed, F.lit(NOW)), B.bronze_rejects(table, parsed), parsed

    return run


def test_messages(spark, upsert):
    raw = spark.createDataFrame([(0, "{"), (1, '{"type":"PING"}'), (2, item()), (3, "5")], "seq bigint, value string")
    parsed, rejects = parse_messages(raw)
    assert [r["seq"] for r in parsed.collect()] == [2]
    assert {r["seq"]: r["reason"] for r in rejects.collect()} == {0: "malformed", 1: "unknown_type", 3: "unknown_type"}


def test_insert_then_update(upsert, spark):
    out, rejects, _ = upsert(
        [
            item(start_url_id="bad", metadata={"a": 1}), item(start_url_id=BOARD, raw_content="y", metadata={"b": 2}),
            item(start_url_id="33333333-3333-3333-3333-333333333333", raw_content="z", metadata={}),
        ]
    )
    row = out.first()
    assert (row["raw_content"], row["start_url_id"], row["last_seen_run_id"]) == ("z", BOARD, RUN)
    assert out.select(F.to_json("metadata")).first()[0] == "{}"
    assert rejects.count() == 0


def test_first_board_is_kept_and_row_revived(upsert, spark):
    first, _, _ = upsert([item(start_url_id=BOARD)])
    closed = first.withColumn("deleted_at", F.lit(NOW)).withColumn("created_at", F.lit(NOW - timedelta(days=9)))
    again, _, _ = upsert([item(start_url_id="33333333-3333-3333-3333-333333333333", raw_content="new")], closed)
    row = again.first()
    assert (row["start_url_id"], row["deleted_at"], row["raw_content"]) == (BOARD, None, "new")
    assert row["created_at"] == NOW - timedelta(days=9) and row["updated_at"] == NOW


def test_unusable_items(upsert):
    out, rejects, _ = upsert(
        [
            item(url=None), item(url="u1", run=None), item(url="u2", run="nope"), item(url="u3", source_url="drop"),
            item(url="u4", raw_content=None), item(url="u5", metadata=[1]), item(url="u6", start_url_id=5),
            json.dumps({"type": "ITEM", "run_id": RUN}),
        ]
    )
    assert [r["url"] for r in out.collect()] == ["u6"]
    assert {r["reason"] for r in rejects.collect()} == {
        "no_url", "no_item_or_run", "bad_run_id", "no_source_url", "no_raw_content", "bad_metadata",
    }


def test_missing_content_type_defaults_on_insert_and_fails_on_update(upsert):
    out, rejects, _ = upsert([item(content_type=None, raw_content="a"), item(content_type=None, raw_content="b")])
    assert (out.first()["content_type"], out.first()["raw_content"]) == ("text/html", "a")
    assert [(r["seq"], r["reason"]) for r in rejects.collect()] == [(1, "no_content_type")]
    later, rejects, _ = upsert([item(content_type=None, raw_content="c")], out)
    assert later.first()["raw_content"] == "a" and rejects.count() == 1


def test_run_registry(upsert, spark):
    other = "44444444-4444-4444-4444-444444444444"
    _, _, parsed = upsert(
        [
            item(), json.dumps({"type": "START_RUN", "run_id": RUN, "spider_name": "late"}),
            json.dumps({"type": "START_RUN", "run_id": other, "spider_name": "google", "timestamp": 5.0}), item(run=other, metadata={"spider": "x"}),
            json.dumps({"type": "END_OF_RUN", "run_id": "bad"}), json.dumps({"type": "START_RUN", "spider_name": "none"}),
        ]
    )
    got = {r["id"]: r["spider_name"] for r in B.run_registry(parsed).collect()}
    assert got == {RUN: "unknown", other: "google"}


@pytest.mark.parametrize("runs, closed", [(4, {"old"}), (3, set())])
def test_tombstone(spark, runs, closed):
    history = [(f"r{i}", "s", NOW - timedelta(hours=i)) for i in range(runs)] + [("other", "t", NOW - timedelta(days=9))]
    table = spark.createDataFrame(history, schemas.RUNS)
    rows = spark.createDataFrame(
        [("new", "r0", None), ("edge", "r2", None), ("old", "r3", None), ("done", "r3", NOW), ("norun", None, None), ("else", "other", None)],
        "url string, last_seen_run_id string, deleted_at timestamp",
    )
    later = NOW + timedelta(days=1)
    got = {r["url"]: r["deleted_at"] for r in B.tombstone(rows, table, F.lit(later)).collect()}
    assert {u for u, at in got.items() if at == later} == closed and got["done"] == NOW


def test_run_outcome(spark):
    log = spark.createDataFrame([("a", "item"), ("b", "error"), ("c", "item"), ("c", "error"), ("c", "error")], "run_id string, kind string")
    got = {r["run_id"]: (r["exit_code"], r["reason"]) for r in B.run_outcome(log).collect()}
    assert got == {"a": (0, "ok"), "b": (1, "no items scraped"), "c": (1, "2 error(s) logged")}


# --- rules and mapping ---


def rule(kind, fields, domains=("api.example.com",)):
    return {"version": 1, "type": kind, "domains": list(domains), "fields": fields}


INDEX = rule("index", {"postings": "jobs[]", "posting_url": "url"})


@pytest.mark.parametrize(
    "change",
    [
        {"version": 7}, {"version": True}, {"type": "other"}, {"domains": []}, {"domains": "x"}, {"domains": [1]}, {"fields": {}},
        {"fields": {"postings": "jobs["}}, {"fields": {"postings": "jobs[]"}}, {"extra": 1}, {"fields": []},
        {"fields": {"postings": "jobs[]", "posting_url": 5}}, {"fields": {"postings": "jobs[]", "posting_url": {"sql": "no_such(doc)"}}},
        {"fields": {"postings": "jobs[]", "posting_url": {"path": "a", "apply": ["nope"]}}}, {"fields": {"postings": "jobs[]", "posting_url": "a", "title": "t"}},
    ],
)
def test_bad_rules_are_refused(spark, change):
    with pytest.raises(R.RuleError):
        R.parse_rule({**INDEX, **change}, spark)


def test_rules_load_in_order_and_last_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(INDEX))
    (tmp_path / "b.json").write_text("{")
    (tmp_path / "c.json").write_text(json.dumps(rule("index", {"postings": "[]", "posting_url": "u"})))
    rules, skipped = R.load_rules(spark, str(tmp_path))
    assert len(rules) == 2 and skipped.count() == 1
    winners, collisions = R.resolve_rules(R.rules_table(spark, rules))
    assert [r["rule_id"] for r in winners.collect()] == [1] and collisions.count() == 1


def refs_of(spark, document, index=INDEX, stored="https://api.example.com/jobs"):
    rules = [R.parse_rule(index, spark)]
    winners, _ = R.resolve_rules(R.rules_table(spark, rules))
    body = document if isinstance(document, bytes) else json.dumps(document, ensure_ascii=False).encode()
    responses = spark.createDataFrame(
        [("r", "https://api.example.com/v1/jobs", stored, None, bytearray(body))],
        "response_id string, response_url string, stored_url string, start_url_id string, body binary",
    )
    return ingest_api(responses, rules, winners, "spider")


def urls_of(batch):
    return sorted(r["url"] for r in batch.items.select("item.url").collect())


def test_index_mapping_drops_odd_elements_alone(spark):
    jobs = [{"url": "https://x.io/1"}, {"url": "p/2"}, {"url": ""}, {"url": 3}, {"url": None}, {}, {"url": "http://[bad"}, "text", None]
    assert urls_of(refs_of(spark, {"jobs": jobs})) == ["https://api.example.com/v1/p/2", "https://x.io/1"]
    for odd in ("text", {"url": "u"}, [], None):
        assert urls_of(refs_of(spark, {"jobs": odd})) == []
    assert refs_of(spark, b"{").refused.first()["reason"] == "unparseable_content"
    assert refs_of(spark, 5).refused.first()["reason"] == "unparseable_content"


def test_bare_ids_have_to_be_fetched(spark):
    bare = rule("index", {"postings": "jobs[]", "posting_url": {"sql": "concat('p/', try_variant_get(element, '$', 'string'))"}})
    bare_rule = R.parse_rule(bare)
    winners, _ = R.resolve_rules(R.rules_table(spark, [bare_rule]))
    responses = spark.createDataFrame(
        [("r", "https://api.example.com/", None, '{"jobs":["1","2",null]}')], "response_id string, response_url string, start_url_id string, text string"
    ).withColumn("doc", F.parse_json("text"))
    attached = M.attach_rule(responses, winners, R.INDEX, F.col("response_url"), ["response_id"])
    got = M.map_index(attached, [bare_rule]).collect()
    assert sorted(r["url"] for r in got) == ["https://api.example.com/p/1", "https://api.example.com/p/2"]
    assert all(r["document"] is None for r in got)


def test_items_keep_text_and_name_their_feed(spark):
    row = refs_of(spark, {"jobs": [{"url": "https://x.io/1", "t": "Zürich"}]}).items.select("item.*").first()
    assert row["raw_content"] == '{"t":"Zürich","url":"https://x.io/1"}'
    assert (row["content_type"], row["source_url"]) == ("application/json", "https://api.example.com/v1/jobs")


JOBS = [
    {"url": "https://x.io/1", "offices": [{"name": "Berlin"}], "remote": False, "n": 5},
    {"url": "https://x.io/2", "offices": [{"name": "Zurich"}, {"name": "Bern"}], "remote": True},
    {"url": "https://x.io/3", "offices": [{"name": "Paris"}], "remote": "True"},
]


@pytest.mark.parametrize(
    "query, kept, reason",
    [
        ("filter.offices[].name=Berlin&filter.offices[].name=Bern", [1, 2], None), ("filter.offices[].name=Berlin&filter.remote=false", [1], None),
        ("filter.remote=true", [2], None), ("filter.ofices[].name=Berlin", [], "unresolved_key"), ("filter.offices[].name=Rome", [], None),
        ("filter.no_such(title)=x", [], "invalid_key"), ("per=5", [1, 2, 3], None), ("filter.n=5", [1], None), ("filter.offices=x", [], None),
        ("%66ilter.remote=True", [3], None),
    ],
)
def test_posting_filters(spark, query, kept, reason):
    batch = refs_of(spark, {"jobs": JOBS}, stored=f"https://api.example.com/jobs?{query}")
    assert urls_of(batch) == [f"https://x.io/{i}" for i in kept]
    assert [r["reason"] for r in batch.refused.collect()] == ([reason] if reason else [])


def test_postings_without_documents_bypass_filters(spark):
    refs = F.array(F.struct(F.lit(0).alias("position"), F.lit("u").alias("url"), F.lit(None).cast("variant").alias("document")))
    responses = spark.createDataFrame([("r", "https://a/?filter.x=1")], "response_id string, stored_url string").withColumn("refs", refs)
    kept, refused = P.apply_posting_filters(responses)
    assert [r["url"] for r in kept.collect()] == ["u"] and refused.count() == 0


POSTING = {
    "absolute_url": "https://job-boards.greenhouse.io/a/jobs/1", "title": "Reef Surveyor", "company_name": "Acme",
    "location": {"name": "Bergen"}, "offices": [{"id": 1, "name": "Bergen, NO"}], "departments": [{"id": 2, "name": "Mapping"}],
    "metadata": [{"name": "Location Type", "value": "On-Site", "id": 3, "value_type": "single_select"}],
    "pay_input_ranges": [{"min_cents": 4120000, "max_cents": 5230000, "currency_type": "EUR", "title": "Annual Salary:"}],
    "content": "&lt;h2&gt;&lt;strong&gt;About&lt;/strong&gt;&lt;/h2&gt;\n&lt;p&gt;It&amp;rsquo;s good.&lt;/p&gt;", "internal_job_id": None,
}


@pytest.fixture
def silver(spark):
    rules, _ = R.load_rules(spark, SHIPPED)
    rules.append(R.parse_rule(rule("detail", {"title": "t", "company_name": "c", "description": "d", "locations": "l", "metadata": "m", "employment_type": "e"})))
    winners, _ = R.resolve_rules(R.rules_table(spark, rules))

    def run(*rows):
        data = [(f"https://p.io/{i}", body, kind, source, None) for i, (body, kind, source) in enumerate(rows)]
        bronze = spark.createDataFrame(data, "url string, raw_content string, content_type string, source_url string, start_url_id string")
        return S.silver_batch(bronze, rules, winners, F.lit(NOW))

    return run


FEED = "https://boards-api.greenhouse.io/v1/boards/a/jobs?content=true"


def test_shipped_detail_rule(silver):
    row = silver((json.dumps(POSTING), "application/json", FEED)).accepted.first()
    assert (row["title"], row["company_name"], row["locations"], row["categories"]) == ("Reef Surveyor", "Acme", ["Bergen, NO"], ["Mapping"])
    assert row["description"] == "# **About**\n\nIt’s good."
    assert (float(row["pay_min"]), float(row["pay_max"]), row["pay_currency"], row["pay_period"]) == (41200.0, 52300.0, "EUR", "year")
    empty = {**POSTING, "pay_input_ranges": [], "metadata": []}
    row = silver((json.dumps(empty), "application/json", FEED)).accepted.select("pay_min", F.to_json("metadata").alias("m")).first()
    assert (row["pay_min"], row["m"]) == (None, "{}")


def test_refusals(silver):
    def doc(**k):
        base = {"t": "T", "c": "C", "d": "D"}
        base.update(k)
        return (json.dumps(base), "application/json", "https://api.example.com/f")

    batch = silver(
        doc(), doc(t=None), doc(c=""), doc(d=5), doc(l="Zurich"), doc(l=["a", None]), doc(m=[1]), doc(e=5), doc(l=[], m={"k": ""}),
        ("{", "application/json", "https://api.example.com/f"), ("5", "application/json", "https://api.example.com/f"),
        ("{}", "application/json", "https://unknown.io/f"), (json.dumps({**POSTING, "content": ["x"]}), "application/json", FEED),
        ("{}", "application/json", "no-authority"),
    )
    assert sorted(r["url"][-1] for r in batch.accepted.collect()) == ["0", "8"]
    got = {r["posting_url"].rsplit("/", 1)[1]: (r["domain"], r["reason"], r["detail"]) for r in batch.events.collect()}
    assert got["1"] == ("api.example.com", "invalid_shape", "'title' must be a non-blank string")
    assert got["4"][2] == got["5"][2] == "'locations' must be a list of strings"
    assert (got["6"][2], got["7"][2]) == ("'metadata' must be an object", "'employment_type' must be a string")
    assert got["9"][1] == "unparseable_content" and got["10"][1:] == ("unparseable_content", "int")
    assert got["11"] == ("unknown.io", "no_rule", None) and got["12"][1] == "rule_raised"
    assert got["13"][:2] == ("(unknown)", "no_rule")
    assert [r["host"] for r in batch.detail_requests.collect()] == ["unknown.io"]


def test_parameters_send_a_row_to_the_page_path(silver):
    batch = silver(("{}", "application/json; charset=utf-8", FEED), ("<p>x</p>", "text/html", "https://p.io/1"))
    assert batch.page_requests.count() == 2 and batch.events.count() == 0


def test_silver_upsert(spark, silver):
    rows = silver((json.dumps({"t": "T", "c": "C", "d": "D"}), "application/json", "https://api.example.com/f")).accepted
    stored = S.silver_upsert(schemas.empty(spark, schemas.SILVER), rows, F.lit(NOW))
    first = stored.first()
    again = S.silver_upsert(stored, rows.withColumn("title", F.lit("T2")), F.lit(NOW + timedelta(days=1))).first()
    assert (again["id"], again["created_at"], again["title"]) == (first["id"], NOW, "T2")
    assert again["updated_at"] == NOW + timedelta(days=1) and again["deleted_at"] is None


def test_custom_rule_serves_its_domain(spark):
    bronze = spark.createDataFrame(
        [("https://p.io/1", "{}", "application/json", "https://mine.io/f", None)],
        "url string, raw_content string, content_type string, source_url string, start_url_id string",
    )

    def mine(df):
        absent = F.lit(None).cast("variant")
        fields = {f: absent for f in R.SILVER_FIELDS} | {f: F.lit(f).cast("variant") for f in ("title", "company_name", "description")}
        return df.withColumn("mapped", F.struct(*[v.alias(k) for k, v in fields.items()]))

    rules, _ = R.load_rules(spark, SHIPPED)
    winners, _ = R.resolve_rules(R.rules_table(spark, rules))
    batch = S.silver_batch(bronze, rules, winners, F.lit(NOW), {("detail", "mine.io"): mine})
    assert batch.accepted.first()["title"] == "title" and batch.events.count() == 0


def test_parts_fold_to_the_same_in_any_grouping(spark, upsert, tmp_path):
    """Items in one batch, or a batch each, put twice and compacted half-way."""
    sent = [
        item(content_type="drop", raw_content="typeless"), item(start_url_id="bad"), item(raw_content="newer", start_url_id=BOARD),
        item(content_type="drop", raw_content="too late"), item(url="https://a.io/2", content_type="drop", start_url_id=BOARD),
        item(url="https://a.io/2", content_type="drop", raw_content="second"),
    ]
    columns = ["url", "raw_content", "content_type", "last_seen_run_id", "start_url_id", "deleted_at"]
    whole, _, parsed = upsert(sent)
    want = {tuple(r) for r in whole.select(*columns).collect()}
    table = I.Tables.under(spark, str(tmp_path)).bronze
    assert table.read().collect() == []
    for batch in (0, 1, 2, 2, 3, 4, 5):
        table.put(B.fold_items(parsed.filter(F.col("seq") == batch), F.lit(NOW), batch), batch)
        if batch == 3:
            table.compact(2)
    assert {tuple(r) for r in table.read().select(*columns).collect()} == want
    assert {r.url for r in table.read(before=4).collect()} == {"https://a.io/1"}


def test_cutoffs_close_rows_until_they_are_seen_again(spark):
    runs = spark.createDataFrame([(f"r{i}", "s", NOW + timedelta(days=i)) for i in range(6)], schemas.RUNS)
    cutoffs = spark.createDataFrame(
        [("s", NOW + timedelta(days=2), 3, NOW + timedelta(days=10)), ("s", NOW + timedelta(days=3), 5, NOW + timedelta(days=11)), ("other", NOW + timedelta(days=99), 1, NOW)],
        "spider_name string, cutoff timestamp, batch bigint, at timestamp",
    )
    closed = B.closings(cutoffs, runs)
    rows = spark.createDataFrame(
        [("old", "r0", 0), ("late", "r1", 4), ("kept", "r3", 1), ("middle", "r2", 2), ("latest", "r0", 6), ("unknown", "x", 0)], "url string, last_seen_run_id string, seen bigint"
    ).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    for small in (True, False, None):
        found = {r.url: r.deleted_at and (r.deleted_at - NOW).days for r in B.closed_by(rows, closed, small).collect()}
        assert found == {"old": 10, "late": 11, "kept": None, "middle": 11, "latest": None, "unknown": None}


def test_a_batch_judges_once_and_reads_its_own_folders(spark):
    """Every output is a scan of the judged folder; accepted rows read no refused ones."""
    rules, _ = R.load_rules(spark, SHIPPED)
    winners, _ = R.resolve_rules(R.rules_table(spark, rules))
    rows = [("https://x.io/1", "{", "application/json"), ("https://x.io/2", "<p>", "text/html"), ("https://x.io/3", "{}", "application/json")]
    bronze = spark.createDataFrame([(u, c, t, u, None) for u, c, t in rows], "url string, raw_content string, content_type string, source_url string, start_url_id string")
    batch = S.silver_batch(bronze, rules, winners, F.lit(NOW))
    for output in (batch.accepted, batch.events, batch.detail_requests, batch.page_requests, batch.outcomes):
        plan = output._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Python" not in plan
    assert "PartitionFilters: [isnotnull(outcome" in batch.accepted._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert {tuple(r) for r in batch.outcomes.collect()} == {("https://x.io/1", True, "unparseable_content"), ("https://x.io/2", False, "no_rule"), ("https://x.io/3", True, "no_rule")}
    assert [r.url for r in batch.page_requests.collect()] == ["https://x.io/2"] and [r.host for r in batch.detail_requests.collect()] == ["x.io"]


def test_registered_functions(spark):
    from gleanwork.functions.registered import register_functions

    register_functions(spark)
    made = R.parse_rule(rule("detail", {"title": {"sql": "markdown(unescape(try_variant_get(doc, '$.t', 'string')))"}}), spark)
    docs = spark.createDataFrame([('{"t":"&lt;b&gt;x&lt;/b&gt;"}', 0)], "t string, rule_id int").withColumn("doc", F.parse_json("t"))
    assert M.map_detail(docs, [made]).select(F.to_json("mapped.title")).first()[0] == '"**x**"'
    row = spark.sql("SELECT hundredths(parse_json('150')) AS a, hundredths(parse_json('true')) AS b, pay_period('Annual pay') AS c, pay_period('per week or day') AS d").first()
    assert tuple(row) == (1.5, None, "year", None)


def test_custom_index_code(spark):
    responses = spark.createDataFrame(
        [("r", "https://mine.io/feed", "https://mine.io/feed", None, bytearray(b'{"u":"https://x.io/9"}'))],
        "response_id string, response_url string, stored_url string, start_url_id string, body binary",
    )
    rules = [R.parse_rule(INDEX)]
    winners, _ = R.resolve_rules(R.rules_table(spark, rules))

    def mine(df):
        ref = F.struct(F.lit(0).alias("position"), F.try_variant_get("doc", "$.u", "string").alias("url"), F.col("doc").alias("document"))
        return df.withColumn("refs", F.array(ref))

    batch = ingest_api(responses, rules, winners, "spider", {"mine.io": mine})
    assert urls_of(batch) == ["https://x.io/9"] and batch.requests.count() == 0
