import html
import json
from datetime import datetime
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions import ids, pay, text, urls


def test_url_host(values):
    given = ["https://Ported.IO:8443/jobs", "www.google.com/search", "not a url at all", "http://u:p@a.b/x",
             "https://[::1]:8080/x", "http://[bad", "", "/path", "//host.x/y"]
    assert values(urls.url_host, given) == [
        "ported.io", "www.google.com", "not a url at all", "a.b", "::1", None, None, None, "host.x",
    ]
    assert values(urls.url_hostname, ["www.google.com/search", "HTTP://A.b/c"]) == [None, "a.b"]


BASES = ["https://a.com/careers", "https://a.com/x/y/z?p=1#f", "https://a.com", "http://a.com/x/", "https://a.com/x?q=/../b"]
REFS = ["/jobs/1", "jobs/1", "", "#top", "?page=2", "../up", "./here", "../../../../far", "//other.io/p", "x/../y/./z",
        "https://abs.io/a/../b", "mailto:a@b.c", "/a//b", "a//b", ".", "..", "/x/../y?z=1#w", "g;x=1", "a?b=c/../d", "jobs/results/1", "a/./b/../../c/..", "/a/b/../../../c/.", "../..", "x/..", "a/b/.."]


def test_url_join_agrees_with_the_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFS]
    df = spark.createDataFrame(rows, "b string, r string")
    got = df.select("b", "r", urls.url_join(F.col("b"), F.col("r")).alias("u")).collect()
    wrong = [(x.b, x.r, x.u, urljoin(x.b, x.r)) for x in got if x.u != urljoin(x.b, x.r)]
    assert wrong == []


def test_url_join_drops_unparseable(values):
    assert values(lambda x: urls.url_join(F.lit("https://a.com/"), x), ["http://[bad"]) == [None]


def test_strip_filter_params(values):
    given = ["https://x.io/j?fields=a,b&filter.x=1", "https://x.io/j?filter.x=1", "https://x.io/j?arr[]=1&flag",
             "https://x.io/j?%66ilter.remote=true&k=%2f", "https://x.io/j?a=1&&b=2#frag", "https://x.io/j", "https://x.io/j?a=100%"]
    assert values(urls.strip_filter_params, given) == [
        "https://x.io/j?fields=a,b", "https://x.io/j", "https://x.io/j?arr[]=1&flag", "https://x.io/j?k=%2f",
        "https://x.io/j?a=1&b=2#frag", "https://x.io/j", "https://x.io/j?a=100%",
    ]


def test_filter_params_agree_with_strip(values):
    got = values(urls.filter_params, ["https://x.io/?filter.a=1&b=2&filter.a=3&%66ilter.c=x+y&filter.d="])[0]
    assert [(g["key"], g["values"]) for g in got] == [("a", ["1", "3"]), ("c", ["x y"]), ("d", [""])]


def test_next_page(values):
    given = ["https://x.io/j?page=1", "https://x.io/j", "https://x.io/j?a=1&a=2&page=9&b=x y~*", "https://x.io/j?page=z"]
    assert values(urls.next_page_url, given) == [
        "https://x.io/j?page=2", "https://x.io/j?page=2", "https://x.io/j?a=1&a=2&page=10&b=x+y~%2A", None,
    ]


def test_media_type_and_slug(values):
    assert values(urls.bare_media_type, ["Text/HTML; charset=utf-8", None, "", "application/json"]) == [
        "text/html", "text/html", "text/html", "application/json",
    ]
    assert values(urls.domain_slug, ["job-boards.greenhouse.io", "A--b."]) == ["job_boards_greenhouse_io", "a_b"]


def test_uuid(values):
    u = "12345678-1234-5678-1234-567812345678"
    given = [u, u.replace("-", ""), "{" + u.upper() + "}", "urn:uuid:" + u, "nope", "", None]
    assert values(ids.uuid_or_null, given) == [u, u, u, u, None, None, None]
    assert values(lambda x: ids.uuid_value_or_null(F.parse_json(x)), [json.dumps(u), "5", "[]", "true"]) == [u, None, None, None]


def test_snippet(values):
    given = ["# Role\n\n" + "x" * 300, "see [docs](http://a/b) for node_modules and _this_ **now**", "> a `b` * c", "é_ü _é_"]
    got = values(text.snippet, given)
    assert len(got[0]) == 240 and "#" not in got[0]
    assert got[1:] == ["see docs for node_modules and this now", "a b c", "é_ü é"]


def test_unescape(values):
    given = ["&lt;p&gt;", "&amp;lt;", "&hellip;&#39;&#x41;", "plain", None]
    assert values(text.unescape, given) == [html.unescape(g) if g else None for g in given]


def test_relative_time(values):
    now = datetime(2026, 1, 10, 12, 0, 0)
    given = [datetime(2026, 1, 10, 12, 5), datetime(2026, 1, 10, 11, 30, 30), datetime(2026, 1, 10, 11, 0), datetime(2026, 1, 9, 12), datetime(2026, 1, 1)]
    got = values(lambda x: text.relative_time(x, F.lit(now)), given, "timestamp")
    assert got == ["0m ago", "30m ago", "1h ago", "1d ago", "10d ago"]


def test_fences_and_salvage(values):
    assert values(text.strip_fences, ["```json\n{}\n```", "x", "  ```\n\na\nb\n```  ", "```"]) == ["{}\n", "x\n", "a\nb\n", "\n"]
    got = values(lambda x: F.to_json(D.json_salvage(x)), ['{"a":1}', 'Sure: ```{"a": {"b": 2}}``` done', "[1]", "no", "}{", '[{"a":1}]'])
    assert got == ['{"a":1}', '{"a":{"b":2}}', "{}", "{}", "{}", '{"a":1}']


def test_decode_body(values):
    t = '{"a":"Zürich"}'
    given = [t.encode("utf-8"), t.encode("utf-8-sig"), t.encode("utf-16"), t.encode("utf-16-le"), t.encode("utf-16-be"),
             t.encode("utf-32"), t.encode("utf-32-le"), t.encode("utf-32-be"), b"\xff\xfa{}", b"{}", b""]
    got = values(text.decode_body, given, "binary")
    assert got[:8] == [t] * 8
    assert got[8:] == [None, "{}", ""]


def test_pay_period(values):
    given = ["Annual Salary:", "per-year-salary", "1 YEAR", "per-hour-wage", "Daily rate", "per week", "Monthly",
             "Commission", "Annual Salary (40 hours per week)", "Monday shift"]
    assert values(pay.pay_period, given) == ["year", "year", "year", "hour", "day", "week", "month", None, None, None]


BASE = {"min": 155000, "max": 205000, "currency": "EUR", "period": "year"}


@pytest.mark.parametrize(
    "change, rule",
    [
        ({}, None), ({"max": None}, None), ({"min": None}, None), ({"min": None, "max": None}, "no_bound"),
        ({"x": 1}, "wrong_keys"), ({"min": True}, "min_not_positive"), ({"max": 0}, "max_not_positive"),
        ({"min": "5"}, "min_not_positive"), ({"min": 300000}, "min_over_max"), ({"max": 1e10}, "max_too_large"),
        ({"min": 0.001}, "min_rounds_to_zero"), ({"currency": "eur"}, "bad_currency"), ({"currency": "EURO"}, "bad_currency"),
        ({"period": "decade"}, "bad_period"), ({"period": None}, "bad_period"), ({"currency": "EUR\n"}, "bad_currency"),
        ({"max": 9999999999.99}, None),
    ],
)
def test_pay_rules(values, change, rule):
    assert values(lambda x: pay.pay_violation(F.parse_json(x)), [json.dumps({**BASE, **change})]) == [rule]


def test_pay_other_kinds_and_columns(spark, values):
    assert values(lambda x: pay.pay_violation(F.try_parse_json(x)), ["5", '"x"', "null", None, "[]"]) == [
        "not_an_object", "not_an_object", None, None, "not_an_object",
    ]
    df = spark.createDataFrame([(json.dumps({**BASE, "min": 2.675}),), ('{"min":1}',)], "x string")
    got = df.select(*[c.alias(n) for n, c in pay.pay_columns(F.parse_json("x")).items()]).collect()
    assert (str(got[0].pay_min), str(got[0].pay_max), got[0].pay_currency, got[0].pay_period) == ("2.68", "205000.00", "EUR", "year")
    assert list(got[1]) == [None] * 4


def test_hundredths(values):
    got = values(lambda x: pay.hundredths(F.parse_json(x)), ["15500000", "1.5", "true", '"1"', "null"])
    assert got == [155000.0, 0.015, None, None, None]


def test_format_pay(spark):
    rows = [(1.0, None, "EUR", "hour"), (None, 90000.0, "GBP", "year"), (50.5, 50.5, "USD", "day"), (155000.0, 205000.0, "CHF", "year")]
    df = spark.createDataFrame(rows, "lo double, hi double, c string, p string")
    got = [r[0] for r in df.select(pay.format_pay(*[F.col(c) for c in ("lo", "hi", "c", "p")])).collect()]
    assert got == ["from €1/hour", "up to £90,000/year", "$50.50/day", "CHF 155,000 – CHF 205,000/year"]


def test_metadata_helpers(values):
    assert values(text.humanize_key, ["experience_level", "_x_", ""]) == ["Experience level", "X", ""]
    given = ['"a"', "5", "1.5", '["a",2]', "[]", '""', "true", "{}", "null", '["a",true]', '["a",""]']
    assert values(lambda x: D.metadata_text(F.parse_json(x)), given) == ["a", "5", "1.5", "a, 2"] + [None] * 7
    got = values(lambda x: F.to_json(D.drop_empty(F.parse_json(x))), ['{"a":"","b":[],"c":{},"d":null,"e":0,"f":false,"g":[null]}', "[1]"])
    assert got == ['{"e":0,"f":false,"g":[null]}', "[1]"]


def test_eval_path(spark):
    doc = '{"a":{"b":[{"c":1},{"c":null},{"d":2},{"c":"x"}]},"n":null,"s":"t","m":[[1,2],[3]],"e":[],"z":[{"l":[1,2]},{"l":[3]},{"l":5}]}'
    paths = ["a.b[].c", "a.b[0].c", "n", "s", "m[]", "e[]", "s[]", "a.b[].d", "missing", "z[].l[]", "a", "e", "z[].l"]
    df = spark.createDataFrame([(i, doc, p) for i, p in enumerate(paths)], "i int, d string, p string")
    found = D.eval_path(F.parse_json("d"), F.col("p"))
    rows = df.select("i", found["resolved"].alias("r"), F.transform(found["items"], lambda t: F.to_json(t)).alias("t")).orderBy("i").collect()
    assert [(r.r, r.t) for r in rows] == [
        (True, ["1", '"x"']), (True, ["1"]), (False, None), (True, ['"t"']), (True, ["1", "2", "3"]), (True, []),
        (False, None), (True, ["2"]), (False, None), (True, ["1", "2", "3"]), (True, ['{"b":[{"c":1},{"c":null},{"d":2},{"c":"x"}]}']),
        (True, []), (True, ["[1,2]", "[3]", "5"]),
    ]
    for i, p in enumerate(paths):
        static = df.filter(F.col("i") == i).select(F.to_json(D.path_value(F.parse_json("d"), p))).first()[0]
        row = rows[i]
        if not row.r:
            assert static is None
        elif "[]" in p or p == "e":
            assert json.loads(static) == [json.loads(t) for t in row.t]


def test_hostname_like_the_standard_library(values):
    given = ["https://A.b:1/c?d#e", "http://x@y:z@h.io/", "https://h.io?x", "ftp://h", "https:///p"]
    assert values(urls.url_hostname, given) == [urlsplit(g).hostname for g in given]
