"""What a mapped row costs: each path is walked once, by compiled columns."""

from pyspark.sql import functions as F

from gleanwork.operators import mapping as M
from gleanwork.operators import rules as R
from gleanwork.operators import silver as S
from gleanwork.operators.joins import pinned

RULE = {
    "version": 1, "type": "detail", "domains": ["a.io"],
    "fields": {"title": "t", "company_name": "c.name", "description": {"path": "d", "apply": ["unescape"]}},
}
BODIES = (
    '{"t":"x","c":{"name":"y"},"d":"&amp;"}', '{"t":null,"c":{"name":"y"},"d":"z"}', '{"t":"x","c":{"name":7},"d":"z"}',
    '{"t":"x","c":{"name":"y"},"d":[1]}', '{"t":"x","c":{"name":"y"},"d":null}', "5", "{",
)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_generator_computes_nothing(spark):
    df = pinned(spark.range(1), x=F.sha2(F.col("id").cast("string"), 256)).filter("x > 'a'")
    generators = [line for line in plan_of(df).split("\n") if "Generate " in line]
    assert generators and not any("sha2" in line for line in generators)


def test_a_path_is_walked_once(spark):
    docs = spark.createDataFrame([(0, "{}")], "rule_id int, text string").select("rule_id", F.try_parse_json("text").alias("doc"))
    plan = plan_of(M.map_detail(docs, [R.parse_rule(RULE)]))
    assert [plan.count(f"$.{path}") for path in ("t,", "c.name,", "d,")] == [1, 1, 1]


def test_an_object_of_paths_is_compiled(spark):
    texts = ['{"x":null}', "{}", '{"x":[1]}', "null"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", F.try_parse_json("text").alias("doc"))
    made = docs.select("i", F.to_json(R.compile_field({"object": {"a": "x"}}, F.col("doc"))[0]).alias("made"))
    assert "transform(" not in plan_of(made)
    assert [r["made"] for r in made.orderBy("i").collect()] == ['{"a":null}', '{"a":null}', '{"a":[1]}', None]


def test_judged_rows(spark):
    rows = [(f"https://x.io/{i}", body, "https://a.io/feed") for i, body in enumerate(BODIES)]
    rows.append(("https://x.io/none", BODIES[0], "https://b.io/feed"))
    rules = [R.parse_rule(RULE)]
    bronze = spark.createDataFrame(rows, "url string, raw_content string, source_url string")
    judged = S.judge_mapped(bronze, rules, R.resolve_rules(R.rules_table(spark, rules))[0], True)
    assert [tuple(r) for r in judged.orderBy("url").select("reason", "detail").collect()] == [
        (None, None),
        ("invalid_shape", "'title' must be a non-blank string"),
        ("invalid_shape", "'company_name' must be a non-blank string"),
        ("rule_raised", "unescape() expects a string, found array"),
        ("invalid_shape", "'description' must be a non-blank string"),
        ("unparseable_content", "int"),
        ("unparseable_content", "malformed JSON"),
        ("no_rule", None),
    ]
