"""Answering a search request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.operators import search as S


@dataclass(frozen=True)
class SearchResult:
    page: DataFrame
    totals: DataFrame
    facets: DataFrame


def search(
    silver: DataFrame, selection: S.Selection, number: int = 1, sort: str = "newest", size: int = S.PAGE_SIZE
) -> SearchResult:
    """The page's summaries, the totals and the facet counts of one request."""
    matched = S.matching(silver, selection)
    return SearchResult(
        summaries(silver, S.page(matched, number, sort, size), sort),
        S.page_totals(matched, size),
        S.ordered_facets(S.facet_counts(silver, selection)),
    )


def summaries(silver: DataFrame, page: DataFrame, sort: str = "newest") -> DataFrame:
    """Summaries of a page's rows.

    The page is found on narrow columns first. Only its ids (a page's worth, never more)
    reach the driver; they go back as a pushed-down filter, so the long description column
    is decoded for the row groups that hold them instead of for the whole table.
    """
    ids = [row["id"] for row in page.select("id").collect()]
    rows = silver.filter(F.col("id").isin(*ids)) if ids else silver.limit(0)
    return S.to_summary(rows.orderBy(*S.sort_keys(sort)))
