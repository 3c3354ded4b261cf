"""Crawl responses to Bronze to Silver, as one chain of frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions.text import decode_body
from gleanwork.functions.urls import url_hostname
from gleanwork.operators import rules as R
from gleanwork.operators.filters import apply_posting_filters
from gleanwork.operators.html import discover
from gleanwork.operators.mapping import attach_rule, index_refs
from gleanwork.operators.silver import SilverBatch, silver_batch
from gleanwork.sources.messages import posting_items


@dataclass(frozen=True)
class ApiBatch:
    items: DataFrame  # envelopes of in-hand postings
    to_fetch: DataFrame  # (start_url_id, url) of postings without a document
    refused: DataFrame  # (response_id, reason)
    requests: DataFrame  # (domain, url, body) of responses no rule serves


Custom = Callable[[DataFrame], DataFrame]


def ingest_api(
    responses: DataFrame, rules: list[R.Rule], winners: DataFrame, spider: str,
    custom: dict[str, Custom] | None = None,
) -> ApiBatch:
    """API responses (response_id, response_url, stored_url, start_url_id, body BINARY).

    `custom` maps a domain to user code that gets that domain's parsed responses and returns
    them with `refs`, an array of (position, url, document).
    """
    text = responses.withColumn("text", decode_body(F.col("body")))
    parsed = text.withColumn("doc", D.parse_document(F.col("text")))
    usable = attach_rule(
        parsed.filter(F.col("doc").isNotNull()), winners, R.INDEX, F.col("response_url"), ["response_id"]
    )
    own = F.coalesce(F.col("host").isin(*custom), F.lit(False)) if custom else F.lit(False)
    found = index_refs(usable.filter(F.col("rule_id").isNotNull() & ~own), rules)
    for domain, code in (custom or {}).items():
        found = found.unionByName(code(usable.filter(F.col("host") == domain)).select(*found.columns))
    kept, unfiltered = apply_posting_filters(found)
    unparseable = parsed.filter(F.col("doc").isNull()).select(
        "response_id", F.lit("unparseable_content").alias("reason")
    )
    return ApiBatch(
        posting_items(kept, spider),
        kept.filter(F.col("document").isNull()).select("start_url_id", "url"),
        unparseable.unionByName(unfiltered),
        usable.filter(F.col("rule_id").isNull() & ~own).select(
            url_hostname(F.col("response_url")).alias("domain"),
            F.col("response_url").alias("url"),
            F.col("text").alias("body"),
        ),
    )


def discover_pages(
    pages: DataFrame, rules: list[R.Rule], winners: DataFrame, custom: dict[str, Custom] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(frontier, learning requests) of listing pages (page_id, url, html, start_url_id).

    `custom` maps a domain to user code that turns that domain's pages into frontier rows.
    """
    attached = attach_rule(pages, winners, R.DISCOVERY, F.col("url"), ["page_id"])
    own = F.coalesce(F.col("host").isin(*custom), F.lit(False)) if custom else F.lit(False)
    frontier, requests = discover(attached.filter(~own), rules)
    for domain, code in (custom or {}).items():
        frontier = frontier.unionByName(code(attached.filter(F.col("host") == domain)).select(*frontier.columns))
    return frontier, requests


def ingest_silver(
    bronze: DataFrame, rules: list[R.Rule], winners: DataFrame, now: Column, **options
) -> SilverBatch:
    return silver_batch(bronze, rules, winners, now, **options)
