"""Silver: Bronze rows to typed postings, refusals and learning requests."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions.ids import url_key
from gleanwork.functions.pay import PAY_COLUMNS, stored_pay
from gleanwork.functions.urls import url_hostname
from gleanwork.operators import rules as R
from gleanwork.operators.html import extract_pages
from gleanwork.operators.joins import pinned
from gleanwork.operators.mapping import attach_rule, map_detail
from gleanwork.schemas import (
    INVALID_SHAPE, JSON_TYPE, NO_RULE, RULE_RAISED, STAGE_DETAIL, UNKNOWN_DOMAIN, UNPARSEABLE,
)
from gleanwork.session import shared_dir

DETAIL_CHARS = 500
REQUIRED = ("title", "company_name", "description")
LISTS = ("locations", "categories")

# The stored detail of a refused shape.
NOT_TEXT = "'{}' must be a non-blank string"
NOT_TEXT_LIST = "'{}' must be a list of strings"
NOT_OBJECT = "'metadata' must be an object"
NOT_STRING = "'employment_type' must be a string"
# The stored detail of a body that is a JSON scalar.
SCALAR_NAMES = {"string": "str", "boolean": "bool", "null": "NoneType"}

Custom = Callable[[DataFrame], DataFrame]


def is_mapped(content_type: Column) -> Column:
    """Exactly the JSON type takes the mapping path; any parameter sends it to HTML."""
    return F.coalesce(content_type == JSON_TYPE, F.lit(False))


def shape_parts(mapped: Column) -> Column:
    """What the shape of a mapped struct of VARIANT fields is judged by, each read once."""
    return F.struct(
        *[(D.string_of(mapped[f]) != "").alias(f) for f in REQUIRED],
        *[D.string_list(mapped[f]).isNotNull().alias(f) for f in LISTS],
        D.entries(mapped["metadata"]).isNotNull().alias("metadata"),
        (F.schema_of_variant(mapped["employment_type"]) == "STRING").alias("employment_type"),
    )


def shape_violation(mapped: Column, parts: Column) -> Column:
    """The first thing wrong with a mapped struct and its `shape_parts`, null when well-shaped."""
    checks: list[Column] = []
    for field in REQUIRED:
        checks.append(F.when(~F.coalesce(parts[field], F.lit(False)), F.lit(NOT_TEXT.format(field))))
    for field in LISTS:
        checks.append(F.when(mapped[field].isNotNull() & ~parts[field], F.lit(NOT_TEXT_LIST.format(field))))
    checks.append(F.when(mapped["metadata"].isNotNull() & ~parts["metadata"], F.lit(NOT_OBJECT)))
    wrong = mapped["employment_type"].isNotNull() & ~parts["employment_type"]
    checks.append(F.when(wrong, F.lit(NOT_STRING)))
    return F.coalesce(*checks)


def body_problem(text: Column) -> Column:
    """Why a body is not a document: the name of a scalar's type, or that it is no JSON."""
    parsed = F.try_parse_json(text)
    kind = D.kind(parsed)
    scalar = F.create_map(*[F.lit(x) for pair in SCALAR_NAMES.items() for x in pair])
    number = F.when(F.to_json(parsed).rlike(r"[.eE]"), F.lit("float")).otherwise(F.lit("int"))
    return F.when(parsed.isNull(), F.lit("malformed JSON")).otherwise(
        F.when(kind == "number", number).otherwise(F.try_element_at(scalar, kind))
    )


def judge_mapped(
    rows: DataFrame, rules: list[R.Rule], winners: DataFrame, small_fits: bool | None = None
) -> DataFrame:
    """Bronze JSON rows plus `mapped`, `reason` and `detail`; reason is null when accepted.

    Looked up by the feed's host, not the posting's: a posting's own address belongs to
    the public site, whose page rule would misread a JSON body.
    """
    attached = attach_rule(
        rows.withColumn("doc", D.parse_document(F.col("raw_content"))),
        winners, R.DETAIL, F.col("source_url"), ["url"], small_fits,
    )
    mapped = pinned(map_detail(attached, rules), __parts=shape_parts(F.col("mapped")))
    violated = pinned(mapped, __violation=shape_violation(F.col("mapped"), F.col("__parts")))
    reason = (
        F.when(F.col("doc").isNull(), UNPARSEABLE)
        .when(F.col("rule_id").isNull(), NO_RULE)
        .when(F.col("rule_error").isNotNull(), RULE_RAISED)
        .when(F.col("__violation").isNotNull(), INVALID_SHAPE)
    )
    judged = pinned(violated, reason=reason)
    r = F.col("reason")
    detail = (
        F.when(r == UNPARSEABLE, body_problem(F.col("raw_content")))
        .when(r == RULE_RAISED, F.col("rule_error"))
        .when(r == INVALID_SHAPE, F.col("__violation"))
    )
    return pinned(judged, detail=detail).drop("rule_error", "doc", "__parts", "__violation")


def judge_pages(
    rows: DataFrame, rules: list[R.Rule], winners: DataFrame, small_fits: bool | None = None
) -> DataFrame:
    """Bronze HTML rows plus `mapped` and `reason`."""
    attached = attach_rule(rows, winners, R.EXTRACTION, F.col("url"), ["url"], small_fits)
    mapped = extract_pages(attached.withColumn("html", F.col("raw_content")), rules).drop("html")
    missing = F.lit(False)
    for field in REQUIRED:
        missing = missing | ~F.coalesce(D.string_of(F.col("mapped")[field]) != "", F.lit(False))
    return mapped.withColumn(
        "reason",
        F.when(F.col("rule_id").isNull(), NO_RULE)
        .when(F.col("mapped").isNull(), "empty_result")
        .when(missing, "missing_required"),
    )


def typed_row(mapped: Column, stored: Column) -> list[Column]:
    """The stored columns of an accepted struct; `stored` is its pay as `stored_pay` gives it."""
    none = F.array().cast("array<string>")
    pay = [stored[name].alias(name) for name in PAY_COLUMNS]
    return [
        D.string_of(mapped["title"]).alias("title"),
        D.string_of(mapped["company_name"]).alias("company_name"),
        D.string_of(mapped["employment_type"]).alias("employment_type"),
        F.coalesce(D.string_list(mapped["locations"]), none).alias("locations"),
        F.coalesce(D.string_list(mapped["categories"]), none).alias("categories"),
        D.string_of(mapped["description"]).alias("description"),
        F.coalesce(D.drop_empty(mapped["metadata"]), F.parse_json(F.lit("{}"))).alias("metadata"),
        *pay,
    ]


def refusal_events(judged: DataFrame, now: Column) -> DataFrame:
    """One ingest event per refused JSON row, without its id."""
    return judged.filter(F.col("reason").isNotNull()).select(
        now.alias("occurred_at"),
        F.coalesce(url_hostname(F.col("source_url")), F.lit(UNKNOWN_DOMAIN)).alias("domain"),
        "start_url_id",
        "source_url",
        F.col("url").alias("posting_url"),
        F.lit(STAGE_DETAIL).alias("stage"),
        "reason",
        F.substring("detail", 1, DETAIL_CHARS).alias("detail"),
    )


ACCEPTED = "accepted"
_JUDGED = ("url", "source_url", "start_url_id", "mapped_path", "detail")


@dataclass(frozen=True)
class SilverBatch:
    accepted: DataFrame  # url and the typed columns
    events: DataFrame  # refused JSON rows
    detail_requests: DataFrame  # host, url, body of JSON rows without a rule; not yet deduped
    page_requests: DataFrame  # url, html_content of HTML rows no rule could read
    outcomes: DataFrame  # url, mapped_path (or read as a page), outcome of every row


def judged_once(json_judged: DataFrame, page_judged: DataFrame, folder: str) -> DataFrame:
    """All judged rows, written under `folder` by outcome and read from there.

    Rows are mapped and pages read once, whatever is asked of the batch, and each output
    reads the folders of its outcomes alone. A body is kept where a request has to show it.
    """

    def part(judged: DataFrame, mapped_path: bool, asks: Column) -> DataFrame:
        reason = F.col("reason")
        paid = pinned(judged, __pay=F.when(reason.isNull(), stored_pay(F.col("mapped.pay"))))
        fields = typed_row(F.col("mapped"), F.col("__pay"))
        return paid.select(
            F.coalesce("reason", F.lit(ACCEPTED)).alias("outcome"),
            *[F.lit(mapped_path).alias(c) if c == "mapped_path" else F.col(c) for c in _JUDGED],
            F.when(asks, F.col("raw_content")).alias("body"),
            F.when(reason.isNull(), F.struct(*fields)).alias("row"),
        )

    both = part(json_judged, True, F.col("reason") == NO_RULE).unionByName(
        part(page_judged.withColumn("detail", F.lit(None).cast("string")), False, F.col("reason").isNotNull())
    )
    both.write.mode("overwrite").partitionBy("outcome").parquet(folder)
    return both.sparkSession.read.schema(both.schema).parquet(folder)


def silver_batch(
    bronze: DataFrame, rules: list[R.Rule], winners: DataFrame, now: Column,
    custom: dict[tuple[str, str], Custom] | None = None, folder: str | None = None,
) -> SilverBatch:
    """Turn Bronze rows into Silver rows and what they were refused for.

    `custom` maps (kind, domain) to user code that gets that domain's slice and returns it
    with a `mapped` struct; every other host goes through the declarative rules. The rows are
    judged in one pass, whose result is written to `folder` (a new one in the shared folder
    if none is named); the outputs are read from there.
    """
    small = len(rules) < 10_000 and sum(len(rule.domains) for rule in rules) < 200_000
    mapped_rows = bronze.filter(is_mapped(F.col("content_type")))
    page_rows = bronze.filter(~is_mapped(F.col("content_type")))
    json_judged = judge_mapped(mapped_rows, rules, winners, small)
    page_judged = judge_pages(page_rows, rules, winners, small)
    for (kind, domain), rule in (custom or {}).items():
        if kind == R.DETAIL:
            json_judged = _with_custom(json_judged, domain, rule)
        elif kind == R.EXTRACTION:
            page_judged = _with_custom(page_judged, domain, rule)
    folder = folder or f"{shared_dir(bronze.sparkSession)}/judged-{uuid.uuid4().hex}"
    judged = judged_once(json_judged, page_judged, folder)
    refused = judged.filter(F.col("outcome") != ACCEPTED)
    no_rule = judged.filter((F.col("outcome") == NO_RULE) & F.col("mapped_path"))
    return SilverBatch(
        judged.filter(F.col("outcome") == ACCEPTED).select("url", "row.*"),
        refusal_events(refused.filter("mapped_path").withColumnRenamed("outcome", "reason"), now),
        no_rule.select(
            url_hostname(F.col("source_url")).alias("host"), F.col("source_url").alias("url"), "body"
        ).filter(F.col("host").isNotNull()),
        refused.filter(~F.col("mapped_path")).select("url", F.col("body").alias("html_content")),
        judged.select("url", "mapped_path", "outcome"),
    )


def _with_custom(judged: DataFrame, domain: str, rule: Custom) -> DataFrame:
    served = rule(judged.filter(F.col("host") == domain).drop("mapped", "reason"))
    missing = F.lit(False)
    for field in REQUIRED:
        missing = missing | ~F.coalesce(D.string_of(F.col("mapped")[field]) != "", F.lit(False))
    served = served.withColumn(
        "reason", F.when(F.col("mapped").isNull() | missing, F.lit(INVALID_SHAPE))
    )
    rest = judged.filter(~F.coalesce(F.col("host") == domain, F.lit(False)))
    return rest.unionByName(served, allowMissingColumns=True)


def silver_upsert(silver: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Replace every field of the rows' urls, keeping id, creation and closing time."""
    fields = [c for c in rows.columns if c != "url"]
    old = silver.select("url", F.struct(*[c for c in silver.columns if c != "url"]).alias("old"))
    new = rows.select("url", F.struct(*fields).alias("new"))
    fresh = F.col("new").isNotNull()

    def latest(name: str) -> Column:
        return F.when(fresh, F.col("new")[name]).otherwise(F.col("old")[name]).alias(name)

    kept = {
        "id": F.coalesce(F.col("old.id"), url_key(F.col("url"))),
        "url": F.col("url"),
        "created_at": F.coalesce(F.col("old.created_at"), now),
        "updated_at": F.when(fresh, now).otherwise(F.col("old.updated_at")),
        "deleted_at": F.col("old.deleted_at"),
    }
    return old.join(new, "url", "full_outer").select(
        *[kept[name].alias(name) if name in kept else latest(name) for name in silver.columns]
    )
