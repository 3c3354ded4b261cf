"""What a query costs a row: work done once, compiled where it can be, a page at a time."""

from pyspark.sql import functions as F

from gleanwork.functions.digests import held_nodes, node_digest
from gleanwork.operators import mapping as M
from gleanwork.operators import rules as R

RULE = {"version": 1, "type": "index", "domains": ["x.example.com"], "fields": {"postings": "jobs[]", "posting_url": "u"}}


def responses(spark):
    jobs = '{"jobs":[{"u":"../p/1?k=2","n":1},{"u":"../../p/./2"},{"u":""},{"n":3},7,null,{"u":"q#f"},{"u":5}]}'
    rows = [(1, "https://x.example.com/v1/b/jobs", jobs), (2, "https://x.example.com", '{"jobs":[{"u":"../p"}]}'), (3, "https://x.example.com/a", '{"jobs":[]}'), (4, None, jobs)]
    df = spark.createDataFrame(rows, "response_id int, response_url string, t string")
    return df.select("response_id", "response_url", F.try_parse_json("t").alias("doc"), F.lit(0).alias("rule_id"))


def test_references_are_built_once_and_by_rows_as_by_lists(spark):
    rules = [R.parse_rule(RULE)]
    read = lambda df: sorted(map(str, df.select("response_id", "position", "url", F.to_json("document").alias("d")).collect()))
    listed = M.index_refs(responses(spark), rules).select("response_id", F.inline("refs"))
    found = M.map_index(responses(spark), rules)
    assert read(found) == read(listed)
    assert {(r["response_id"], r["position"], r["url"]) for r in found.collect()} >= {
        (1, 0, "https://x.example.com/v1/p/1?k=2"), (1, 1, "https://x.example.com/p/2"), (1, 5, "https://x.example.com/v1/b/q#f"), (2, 0, "https://x.example.com/p"),
    }
    # A filter put before the references would build them a second time.
    for df in (listed, found):
        filters = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
        assert not any("lambdafunction" in line or "regexp" in line for line in filters)


def test_held_nodes_are_those_of_equal_digest():
    whole = {"a": [1, 2.0, {"x": True, "y": None}], "b": {"1": "1"}, "c": [], "d": [1.5, -0.0, {}]}
    nodes = [whole, {"y": None, "x": True}, {"x": 1, "y": None}, [], {}, [1.0, 2, {"x": True, "y": None}], {"1": 1}, {"1": "1"}, [1.5, 0, {}], 1, "1", None, ["1.5"], {"x": True}]
    held: set[str] = set()
    node_digest(whole, held)
    assert held_nodes(whole, nodes) == [node_digest(n) in held for n in nodes]
    deep: list = []
    for _ in range(20_000):
        deep = [deep]
    assert held_nodes(deep, [[[]], {}]) == [True, False]


def test_pages_are_made_into_rows_one_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    from gleanwork.operators import html

    sizes = []
    made = pa.array
    monkeypatch.setattr(pa, "array", lambda rows, *a, **k: sizes.append(len(rows)) or made(rows, *a, **k))
    markup = made(["<p>One</p>", None, "<div><b>Two</b></div>", ""])
    nodes = html.shred.func(markup)
    assert len(nodes) == 4 and not nodes[1].is_valid and max(sizes) == 1
