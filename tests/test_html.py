import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import htmltree
from gleanwork.operators import claims as C
from gleanwork.operators import html as H
from gleanwork.operators import learning as L
from gleanwork.operators import quality as Q
from gleanwork.operators import rules as R
from gleanwork.operators import snapshot as S
from gleanwork.plans.ingest import discover_pages
from gleanwork.queries.mapping import SHIPPED


def md(fragment):
    return htmltree.markdown(htmltree.read(fragment))


@pytest.mark.parametrize(
    "fragment, text",
    [
        ("<section><h5>Tides</h5><p>Twice daily.</p></section>", "# Tides\n\nTwice daily."),
        ("<div><h3>Reef</h3><h6>Cove</h6></div>", "# Reef\n\n#### Cove"),
        ("<main><h4>Alone</h4></main>", "# Alone"),
        ("<p>oak</p><div>elm</div><p>ash</p>", "oak\n\nelm\n\nash"),
        ("<ul><li>oak</li><li>elm</li><li>ash</li></ul>", "- oak\n- elm\n- ash"),
        ("<ol start=\"4\"><li>oak</li><li>elm</li></ol>", "4. oak\n5. elm"),
        ("<ul><li>oak<ol><li>leaf</li></ol></li><li>elm</li></ul>", "- oak\n  1. leaf\n- elm"),
        ("<p>a <em>slow</em>, <strong>steady</strong> wind</p>", "a *slow*, **steady** wind"),
        ("<p>by<i> night </i>only</p>", "by *night* only"),
        ('<p>left<img src="m.gif">right</p>', "leftright"),
        ('<p>mind the <a href="/tide?d=1">tide</a></p>', "mind the [tide](/tide?d=1)"),
        ('<a href="ftp://sea.example/a">ftp://sea.example/a</a>', "<ftp://sea.example/a>"),
        ("<p>a<br>b</p>", "a  \nb"),
        ("<p>snake_case 2*3</p>", "snake\\_case 2\\*3"),
        ("<p>one\n   two\tthree</p>", "one\ntwo three"),
        ("<blockquote><p>q</p></blockquote>", "> q"),
        ("<pre>a  b\nc</pre>", "```\na  b\nc\n```"),
        ("<p>x</p><script>y()</script><!-- z -->", "x"),
        ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
        ("&lt;b&gt; &amp; more", "<b> & more"),
        ("<![foo[bar]]>x", "x"),
        ("<![ foo>y", "y"),
        ("<p>&#" + "9" * 5000 + ";z", "\ufffdz"),
        ("<div>" * 700 + "deep" + "</div>" * 700, "deep"),
        ('<ol start="²"><li>a</li></ol>', "1. a"),
        ("<table><tr><td>a<table><tr><td>b</td></tr></table></td></tr></table>", "| a | b | | --- | |\n| --- |"),
        ("", ""),
    ],
)
def test_markdown(fragment, text):
    assert md(fragment) == text


def pages(spark, *rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")
    return df.withColumn("start_url_id", F.lit("b"))


@pytest.fixture
def shipped(spark):
    rules, skipped = R.load_rules(spark, SHIPPED)
    assert skipped.count() == 0 and len(rules) == 5
    return rules, R.resolve_rules(R.rules_table(spark, rules))[0]


def test_substring_links(spark, shipped):
    html = (
        '<a href="/jobs/123">E</a><a href="#/jobs/9">no</a><a href="https://x.io/jobs/456">F</a><a href="/jobs/123">again</a><a href="/about">A</a>'
        '<div data-job-url="/jobs/789"></div><a href="?page=2">Next <b>page</b></a><a href="/p3">»</a><i data-next-page="/p4"></i><a>next</a>'
    )
    given = pages(spark, ("https://job-boards.greenhouse.io/acme", html), ("https://greenhouse.io/x", "<html></html>"), ("https://other.io/a?b", html))
    frontier, requests = discover_pages(given, *shipped)
    got = [(r["kind"], r["url"]) for r in frontier.orderBy("page_id", "kind", "position").collect()]
    site = "https://job-boards.greenhouse.io"
    assert got == [
        ("job", f"{site}/jobs/123"), ("job", "https://x.io/jobs/456"), ("job", f"{site}/jobs/789"),
        ("listing", f"{site}/acme?page=2"), ("listing", f"{site}/p3"), ("listing", f"{site}/p4"),
    ]
    assert [(r["domain"], r["url"]) for r in requests.collect()] == [("other.io", "https://other.io/a?b")]


def test_attribute_links_and_next_page(spark, shipped):
    html = (
        '<head><base href="https://www.google.com/about/"></head><a jsname="hSRGPd" aria-label="Learn more about X" href="jobs/results/1">x</a>'
        '<a jsname="hSRGPd" aria-label="Learn more about Y" href="jobs/results/2">y</a><a jsname="other" aria-label="Learn more" href="z">z</a>'
        '<a jsname="hSRGPd" aria-label="Go to next page" href="ignored">n</a><a jsname="hSRGPd" aria-label="Go to next page">n</a>'
    )
    frontier, _ = discover_pages(pages(spark, ("https://www.google.com/jobs?q=a b&page=1", html)), *shipped)
    got = [(r["kind"], r["url"]) for r in frontier.orderBy("kind", "position").collect()]
    assert got == [
        ("job", "https://www.google.com/about/jobs/results/1"), ("job", "https://www.google.com/about/jobs/results/2"),
        ("listing", "https://www.google.com/jobs?q=a+b&page=2"),
    ]


def test_resolve_honours_base(spark):
    html = '<head><base href="https://pier.example/tour/"></head><body><a href="stop/7">S</a></body>'
    got = H.resolve_links(H.shred_pages(pages(spark, ("https://pier.example/tour/list/", html), ("https://pier.example/open", '<a href="/berth/3">B</a>'))))
    assert sorted(r["url"] for r in got.collect()) == ["https://pier.example/berth/3", "https://pier.example/tour/stop/7"]


def test_clean_and_prune(spark):
    html = (
        "<html><head><title>x</title></head><body><!-- secret --><script>evil()</script><style>.a{}</style><svg><path></path></svg>"
        '<img src=" DATA:image/png;base64,AA"><a href="/dock/8" style="left:0">Caulker <span>II</span></a>'
        '<div class="quay"><p>stay <a href="/d/2">D</a></p></div><div class="filler"><p>prose</p></div></body></html>'
    )
    shredded = H.shred_pages(pages(spark, ("https://a.io/", html)))
    clean = shredded.select(H.to_html(H.clean_nodes(F.col("nodes"))).alias("h")).first()["h"]
    for gone in ("evil", "secret", "title", "svg", "DATA", "left:0", ".a{}"):
        assert gone not in clean
    assert '<a href="/dock/8">Caulker <span>II</span></a>' in clean and "filler" in clean
    lean = shredded.select(H.to_html(H.prune_nodes(F.col("nodes"))).alias("h")).first()["h"]
    assert '<div class="quay"><p>stay <a href="/d/2">D</a></p></div>' in lean and "filler" not in lean and "II" in lean
    none = H.shred_pages(pages(spark, ("https://a.io/", "<html><body><p>no links</p></body></html>")))
    assert none.select(H.to_html(H.prune_nodes(F.col("nodes"))).alias("h")).first()["h"] == ""


PANEL = """
<div class="card"><h2>Other job</h2></div>
<div class="x DkhPwc"><h2> Engineer </h2>
 <div class="op1BBf"><span><i class="google-material-icons">corporate_fare</i><span>Acme</span></span>
  <span><i class="google-material-icons">place</i><span class="r0wTof">Zurich</span><span class="r0wTof">; Bern</span></span>
  <span><i class="google-material-icons">bar_chart</i><button><span class="wVSTAb">Mid</span><div>tooltip</div></button></span></div>
 <div>{note}<h3>Minimum</h3><ul><li>One</li></ul></div><div><p>no heading, no section</p></div><div><h3>About</h3>Text</div></div>"""
NOTE = '<div><i class="google-material-icons">info</i><p>Note: <b>By applying you may share your preferred working location from the following: Sunnyvale, CA, USA; Zürich, Switzerland.</b></p></div>'


def extracted(spark, shipped, html):
    from gleanwork.operators.mapping import attach_rule

    rows = attach_rule(pages(spark, ("https://www.google.com/1", html)), shipped[1], R.EXTRACTION, F.col("url"), ["page_id"])
    mapped = H.extract_pages(rows, shipped[0])
    return json.loads(mapped.select(F.to_json("mapped").alias("m")).first()["m"] or "null")


def test_extraction(spark, shipped):
    got = extracted(spark, shipped, PANEL.format(note=""))
    assert (got["title"], got["company_name"], got["locations"], got["metadata"]) == ("Engineer", "Acme", ["Zurich", "Bern"], {"experience_level": "Mid"})
    assert got["description"] == "# Minimum\n\n- One\n\n# About\n\nText"
    noted = extracted(spark, shipped, PANEL.format(note=NOTE))
    assert noted["locations"] == ["Sunnyvale, CA, USA", "Zürich, Switzerland"]
    assert noted["description"] == got["description"]
    assert extracted(spark, shipped, "<p>no panel</p>") is None


def brute_claims(events, ttl):
    held, granted = {}, set()
    for key, ts, seq, release in sorted(events, key=lambda e: (e[1], e[2])):
        if release:
            held.pop(key, None)
        elif held.get(key, datetime.min) <= ts:
            held[key] = ts + timedelta(seconds=ttl)
            granted.add(seq)
    return granted


@pytest.mark.parametrize("seed, releases", [(1, 0.0), (2, 0.02), (3, 0.4)])
def test_claims_against_a_replay(spark, seed, releases):
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    hosts = ["hot"] * 30 + ["a", "b", "c"]
    events = [
        (rng.choice(hosts), start + timedelta(seconds=rng.randrange(40_000), microseconds=rng.choice((0, 5))), seq, rng.random() < releases)
        for seq in range(4000)
    ]
    df = spark.createDataFrame(events, "key string, ts timestamp, seq bigint, release boolean").withColumn(
        "kind", F.when(F.col("release"), C.RELEASE).otherwise(C.ACQUIRE)
    )
    want = brute_claims(events, 300)
    for rows in (150, 100_000):
        assert {r["seq"] for r in C.granted_claims(df, 300, chunk_rows=rows).collect()} == want


@pytest.mark.parametrize("instants, releases", [(1, 0.0), (3, 0.0), (3, 0.1)])
def test_bursts_at_one_instant(spark, instants, releases):
    """Thousands of events at an instant are cut into runs like any others."""
    rng = random.Random(instants)
    start = datetime(2026, 1, 1)
    events = [(f"h{seq % 2}", start + timedelta(seconds=299 * rng.randrange(instants)), seq, rng.random() < releases) for seq in range(2000)]
    df = spark.createDataFrame(events, "key string, ts timestamp, seq bigint, release boolean").withColumn(
        "kind", F.when(F.col("release"), C.RELEASE).otherwise(C.ACQUIRE)
    )
    assert {r["seq"] for r in C.granted_claims(df, 300, chunk_rows=150).collect()} == brute_claims(events, 300)


def test_claims_meet_no_task_beyond_two_pieces(spark, monkeypatch):
    """One key, arrivals of which no two share an exit: functions stay in pieces of a run."""
    start = datetime(2026, 1, 1)
    events = [("h", start + timedelta(seconds=i), i, False) for i in range(1100)]
    df = spark.createDataFrame(events, "key string, ts timestamp, seq bigint, release boolean").withColumn("kind", F.lit(C.ACQUIRE))
    pieces = []
    composed = C._composed
    monkeypatch.setattr(C, "_composed", lambda p, s: pieces.append(p) or composed(p, s))
    assert {r["seq"] for r in C.granted_claims(df, 400, chunk_rows=80).collect()} == brute_claims(events, 400) == {0, 400, 800}
    assert len(pieces) >= 3
    for level in pieces:
        rows = level.select("span", F.size("upto").alias("n")).collect()
        assert max(r.n for r in rows) <= 80
        # A span's function reaches a TTL past its start, and not further than a run more.
        for span in {r.span for r in rows}:
            assert sum(r.n for r in rows if r.span == span) <= 400 + 2 * 80


def test_claims_start_from_a_state(spark):
    start = datetime(2026, 1, 1)
    events = [("h", start + timedelta(seconds=10 * i), i) for i in range(100)]
    df = spark.createDataFrame(events, "host string, ts timestamp, seq bigint")
    initial = spark.createDataFrame([("h", start + timedelta(seconds=95))], "key string, held_until timestamp")
    for rows in (7, 1000):
        assert sorted(r["seq"] for r in C.request_dedup(df, 300, initial, rows).collect()) == [10, 40, 70]
    # A hold that lasts longer than a TTL, as no grant of these events would give it.
    late = spark.createDataFrame([("h", start + timedelta(seconds=735))], "key string, held_until timestamp")
    assert sorted(r["seq"] for r in C.request_dedup(df, 300, late, 7).collect()) == [74]


def test_failed_push_frees_the_claim(spark):
    start = datetime(2026, 1, 1)
    rows = [("h", start, 0, True), ("h", start + timedelta(seconds=1), 1, False), ("h", start + timedelta(seconds=2), 2, False), (None, start, 3, False)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, seq bigint, push_failed boolean")
    assert [r["seq"] for r in C.request_dedup(df).collect()] == [1]


def brute_trim(text, budget):
    """The last element of the longest array goes, the first such array in the text's order,
    until the text fits; null if no array has two elements left."""
    document = json.loads(text)
    while len(shown := json.dumps(document, indent=2)) > budget:
        arrays, waiting = [], [document]
        while waiting:
            at = waiting.pop()
            if isinstance(at, list):
                arrays.append(at)
            waiting += reversed(at if isinstance(at, list) else [*at.values()] if isinstance(at, dict) else [])
        lengths = [len(a) for a in arrays]
        if max(lengths, default=0) < 2:
            return None
        del arrays[lengths.index(max(lengths))][-1]
    return shown


def test_budget_against_brute_force(spark):
    rng = random.Random(5)

    def tree(depth):
        pick = rng.random()
        if depth == 0 or pick < 0.3:
            return rng.choice([1, "text", None, True, "é", 2.5])
        if pick < 0.6:
            return {f"k{i}": tree(depth - 1) for i in range(rng.randrange(4))}
        return [tree(depth - 1) for _ in range(rng.randrange(6))]

    docs = [json.dumps({"jobs": [tree(3) for _ in range(rng.randrange(8))], "more": tree(4)}) for _ in range(120)]
    budgets = [rng.randrange(30, 900) for _ in docs]
    for budget in (60, 200, 500):
        df = spark.createDataFrame(list(enumerate(docs)), "i int, d string")
        got = [r["t"] for r in df.select("i", L.trim_to_budget(F.col("d"), budget).alias("t")).orderBy("i").collect()]
        assert got == [brute_trim(d, budget) for d in docs]
    assert [L._trimmed(d, b) for d, b in zip(docs, budgets)] == [brute_trim(d, b) for d, b in zip(docs, budgets)]
    assert L.budget_chars("index") == (65536 - 4096) * 2


def test_metadata_rules(spark):
    def rules(metadata, **fields):
        row = json.dumps({"title": "T", "locations": ["Z"], "metadata": metadata, **fields})
        df = spark.createDataFrame([(row,)], "r string")
        return [(f["key"], f["rule"]) for f in df.select(Q.metadata_violations(F.parse_json("r")).alias("v")).first()["v"]]

    assert rules({"level": "Mid", "n": 5, "l": ["a", 2], "e": "", "x": None, "o": {}}) == []
    assert rules({"Bad-Key": "x"}) == [("Bad-Key", "not_snake_case")]
    assert rules({"k": " HTTPS://x.io"}) == [("k", "holds_url")]
    assert rules({"k": ["a", "http://x"]}) == [("k", "holds_url")]
    assert rules({"k": {"deep": [{"u": "http://x"}]}}) == [("k", "holds_url"), ("k", "not_scalar_or_list")]
    assert rules({"k": {"http://key": "v"}}) == [("k", "not_scalar_or_list")]
    assert rules({"k": 'say "http://x"'}) == []
    assert rules({"k": "T"}) == [("k", "repeats_title")] and rules({"k": ["Z"]}) == [("k", "repeats_locations")]
    assert rules({"k": ""}, employment_type="") == []
    assert rules({"k": True}) == [("k", "not_scalar_or_list")] and rules({"k": [{"a": 1}]}) == [("k", "not_scalar_or_list")]
    assert rules([1]) == [("metadata", "not_an_object")] and rules(None) == []


def test_field_differences(spark):
    want = {"title": "T", "company_name": "C", "employment_type": None, "locations": ["a", "b"], "description": "D", "pay": {"min": 1, "max": None, "currency": "EUR", "period": "day"}}
    have = {**want, "locations": ["b", "a", "a"], "description": " D\n", "pay": {"min": 1.0, "max": None, "currency": "EUR", "period": "day"}}
    cases = [({}, []), ({"title": "X"}, [("title", "differs")]), ({"locations": None}, [("locations", "differs")]), ({"pay": None}, [("pay", "differs")])]
    for change, problems in cases:
        frames = [
            spark.createDataFrame([(1, json.dumps(d))], "k int, d string").select("k", F.parse_json("d").alias("doc")) for d in (want, {**have, **change})
        ]
        got = S.field_differences(*frames, "k").collect()
        assert [(r["field"], r["problem"]) for r in got] == problems


def test_foreign_documents_compare_structure(spark):
    response = {"jobs": [{"a": 1.0, "b": [{"c": "x"}]}], "text": '{"z":1}'}
    docs = [{"b": [{"c": "x"}], "a": 1}, {"c": "x"}, {"z": 1}, {"a": 1}]
