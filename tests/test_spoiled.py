"""Rows that must not end a job, and sizes that must not change a result."""

import json

from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions.digests import node_digest
from gleanwork.functions.text import unescape
from gleanwork.functions.urls import next_page_url
from gleanwork.operators import mapping as M
from gleanwork.operators import rules as R
from gleanwork.operators.learning import trim_to_budget
from gleanwork.sources.messages import parse_messages


def test_many_rules_lose_no_row(spark):
    shipped = [
        R.parse_rule({"version": 1, "type": "detail", "domains": [f"h{i}.example"], "fields": {"title": f"t{i}", "description": {"path": "d", "apply": ["unescape", "markdown"]}}})
        for i in range(300)
    ]
    rows = [(i, json.dumps({f"t{i}": f"T{i}", "d": "&lt;p&gt;x&lt;/p&gt;"})) for i in (0, 150, 299, 9999)] + [(None, "{}")]
    df = spark.createDataFrame(rows, "rule_id int, text string").withColumn("doc", F.try_parse_json("text"))
    mapped = M.map_detail(df, shipped)
    plan = mapped._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    found = {r.rule_id: r.t for r in mapped.select("rule_id", F.to_json("mapped.title").alias("t")).collect()}
    assert found == {0: '"T0"', 150: '"T150"', 299: '"T299"', 9999: None, None: None}


def test_leading_blanks_of_any_length(values):
    assert values(lambda x: F.to_json(D.parse_document(x)), [" \n" * 5000 + '{"a":1}', " " * 5000 + "5", "x{"]) == ['{"a":1}', None, None]


def test_quoted_members(spark):
    rows = [('"a.b"',), ("a.b",), ('"a[b"',), ('"x[]"[].y',), ("a[99999999999].b",), ('"it\'s"',)]
    doc = json.dumps({"a.b": 1, "a": {"b": 2}, "a[b": 3, "x[]": [{"y": 4}]})
    df = spark.createDataFrame(rows, "path string").withColumn("doc", F.parse_json(F.lit(doc)))
    usable = F.col("path").rlike(D.PATH_SQL)
    found = df.select("path", usable.alias("ok"), F.to_json(D.eval_path(F.col("doc"), F.when(usable, F.col("path")))["items"]).alias("v")).collect()
    assert [(r.ok, r.v) for r in found] == [(True, "[1]"), (True, "[2]"), (True, "[3]"), (True, "[4]"), (False, None), (False, None)]
    static = spark.range(1).select(F.parse_json(F.lit(doc)).alias("doc"))
    assert static.select(*[F.to_json(D.path_value(F.col("doc"), p)).alias(str(i)) for i, (p,) in enumerate(rows[:4])]).first() == ("1", "2", "3", "[4]")


def test_time_beyond_timestamps_is_a_reject(spark):
    raw = spark.createDataFrame([(1, '{"type":"START_RUN","run_id":"r","spider_name":"s","timestamp":1e30}'), (2, '{"type":"START_RUN","run_id":"r","spider_name":"s","timestamp":1.5}')], "seq long, value string")
    good, bad = parse_messages(raw)
    assert [r.seq for r in good.collect()] == [2]
    assert [(r.seq, r.reason) for r in bad.collect()] == [(1, "malformed")]


def test_last_page_number(values):
    assert values(next_page_url, ["https://x.example/?page=9223372036854775807"]) == [None]


def test_long_references_and_numbers(values):
    assert values(unescape, ["&#" + "9" * 5000 + ";a", "&#" + "0" * 5000 + "65;", "&#65;"]) == ["�a", "A", "A"]
    assert values(lambda x: trim_to_budget(x, 50), ["[" + "1" * 5000 + "]", "[1, 2]"])[1] == "[\n  1,\n  2\n]"


def test_digests_of_deep_documents():
    assert len(node_digest(json.loads("[" * 900 + "]" * 900))) == 64
    assert node_digest({"a": [1, 2.0], "b": {}}) == node_digest({"b": {}, "a": [1.0, 2]})
