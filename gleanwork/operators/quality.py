"""Checks on stored data and on metadata, and the refusal report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanwork.functions import documents as D
from gleanwork.schemas import BOARD_API, HTML_TYPE

OTHER_FIELDS = ("title", "company_name", "employment_type", "locations", "categories", "description")
_TOKEN = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'
_ADDRESS = r'(?iU)^"(?:\s|\\[nrtfb])*https?://'


def _holds_address(value: Column) -> Column:
    """A string at any depth that starts with a web address.

    Canonical JSON text is cut into its string tokens, an object key keeping the colon that
    follows it, so neither keys nor quotes inside a string can be taken for a value.
    """
    tokens = F.regexp_extract_all(F.to_json(value), F.lit(_TOKEN), F.lit(0))
    return F.coalesce(
        F.exists(tokens, lambda token: ~F.endswith(token, F.lit(":")) & token.rlike(_ADDRESS)), F.lit(False)
    )


def metadata_violations(row: Column) -> Column:
    """What in a posting's metadata breaks the rules: array of (key, rule), in key order.

    `row` is a VARIANT object of Silver fields.
    """
    metadata = D.field(row, "$.metadata")
    members = D.entries(metadata)

    def scalar(value: Column) -> Column:
        return F.coalesce(D.kind(value).isin("string", "number"), F.lit(False))

    def broken(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]
        text = F.to_json(value)
        empty = D.is_absent(value) | text.isin('""', "[]", "{}")
        fine = F.when(D.elements(value).isNotNull(), F.forall(D.elements(value), scalar)).otherwise(scalar(value))
        repeats = F.filter(
            F.array(
                *[
                    F.struct(F.lit(f).alias("field"), F.to_json(D.field(row, f"$.{f}")).alias("text"))
                    for f in OTHER_FIELDS
                ]
            ),
            lambda other: other["text"] == text,
        )
        found = F.array(
            F.when(~key.rlike(r"^[a-z][a-z0-9_]*\z"), F.lit("not_snake_case")),
            F.when(_holds_address(value), F.lit("holds_url")),
            F.when(
                ~empty & (F.size(repeats) > 0), F.concat(F.lit("repeats_"), F.get(repeats, F.lit(0))["field"])
            ),
            F.when(~empty & ~fine, F.lit("not_scalar_or_list")),
        )
        return F.transform(
            F.filter(found, lambda rule: rule.isNotNull()),
            lambda rule: F.struct(key.alias("key"), rule.alias("rule")),
        )

    none = F.array().cast("array<struct<key:string,rule:string>>")
    whole = F.array(F.struct(F.lit("metadata").alias("key"), F.lit("not_an_object").alias("rule")))
    ordered = F.array_sort(F.map_entries(F.transform_values(members, lambda k, v: F.to_json(v))))
    rebuilt = F.transform(
        ordered,
        lambda e: F.struct(e["key"].alias("key"), F.try_parse_json(e["value"]).alias("value")),
    )
    return (
        F.when(D.is_absent(metadata), none)
        .when(members.isNull(), whole)
        .otherwise(F.flatten(F.transform(rebuilt, broken)))
    )


def refusal_report(events: DataFrame) -> DataFrame:
    """Refusals per domain, stage and reason."""
    return events.groupBy("domain", "stage", "reason").agg(F.count(F.lit(1)).alias("count"))


def refusal_rollup(events: DataFrame) -> DataFrame:
    """The same with subtotals per domain and overall (null keys are the totals)."""
    return events.rollup("domain", "reason").agg(F.count(F.lit(1)).alias("count"))


def schema_drift(table: str, stored: T.StructType, declared: T.StructType) -> list[tuple]:
    """(table, column, problem, declared, stored) where a stored schema left the declaration."""
    have = {f.name: f.dataType.simpleString() for f in stored}
    want = {f.name: f.dataType.simpleString() for f in declared}
    rows = [(table, c, "missing", t, None) for c, t in want.items() if c not in have]
    rows += [(table, c, "unexpected", None, t) for c, t in have.items() if c not in want]
    rows += [(table, c, "type", t, have[c]) for c, t in want.items() if c in have and have[c] != t]
    return rows


def schema_drift_report(table: str, stored: DataFrame, declared: T.StructType) -> DataFrame:
    return stored.sparkSession.createDataFrame(
        schema_drift(table, stored.schema, declared),
        "table string, column string, problem string, declared string, stored string",
    )


def document_drift(rows: DataFrame, declared: dict[str, str]) -> DataFrame:
    """(domain, column, problem, declared, stored) where stored documents left a declared shape.

    rows(domain, doc VARIANT); `declared` maps a member's name to its type. Each member's type
    is the one that all of a domain's values of it have in common (VARIANT if they have none,
    VOID if all are null), found by a mergeable aggregate over every row. A member no document
    holds is missing, one that is not declared unexpected.
    """
    members = rows.select("domain", F.explode(D.entries(F.col("doc"))).alias("column", "value"))
    stored = members.groupBy("domain", "column").agg(F.schema_of_variant_agg("value").alias("stored"))
    wanted = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("declared")) for c, t in declared.items()])
    want = rows.select("domain").distinct().select("domain", F.inline(wanted))
    both = want.join(stored, ["domain", "column"], "full_outer")
    problem = (
        F.when(F.col("stored").isNull(), "missing")
        .when(F.col("declared").isNull(), "unexpected")
        .when(F.col("stored") != F.col("declared"), "type")
    )
    return both.select("domain", "column", problem.alias("problem"), "declared", "stored").filter(F.col("problem").isNotNull())


def upgrade_bronze(old: DataFrame, payload: str = "raw_html") -> DataFrame:
    """Rows of the HTML-only layout in today's: one renamed and two filled columns."""
    return old.withColumnRenamed(payload, "raw_content").withColumns(
        {"content_type": F.lit(HTML_TYPE), "source_url": F.col("url")}
    )


def upgrade_boards(old: DataFrame) -> DataFrame:
    """Board types of the old vocabulary recoded."""
    return old.withColumn("type", F.when(F.col("type") == "json_api", BOARD_API).otherwise(F.col("type")))


def null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows break each NOT NULL declaration, in one scan."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], columns, "column", "nulls").filter(F.col("nulls") > 0)
