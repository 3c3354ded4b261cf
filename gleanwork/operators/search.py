"""Search over postings: filters, pages, totals and facet counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions.ids import uuid_or_null
from gleanwork.functions.pay import pay_struct
from gleanwork.functions.text import snippet
from gleanwork.schemas import UNSPECIFIED

PAGE_SIZE = 25
FACETS = ("company", "employment_type", "location")


@dataclass(frozen=True)
class Selection:
    """What a reader asked for; an empty facet is off."""

    q: str | None = None
    locations: tuple[str, ...] = ()
    companies: tuple[str, ...] = ()
    employment_types: tuple[str, ...] = ()
    include_closed: bool = False

    def wanted(self, facet: str) -> tuple[str, ...]:
        return {
            "company": self.companies,
            "employment_type": self.employment_types,
            "location": self.locations,
        }[facet]


def search_text(q: str | None, *columns: Column) -> Column:
    """Literal, case-insensitive containment in any of the columns; no term, no filter."""
    if not q:
        return F.lit(True)
    needle = F.lit(q.lower())
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.contains(F.lower(column), needle)
    return hit


def open_only(include_closed: bool) -> Column:
    return F.lit(True) if include_closed else F.col("deleted_at").isNull()


def facet_in(column: Column, values: tuple[str, ...]) -> Column:
    return column.isin(*values) if values else F.lit(True)


def facet_in_or_null(column: Column, values: tuple[str, ...], sentinel: str = UNSPECIFIED) -> Column:
    """Like facet_in, with the sentinel standing for a null."""
    if not values:
        return F.lit(True)
    named = [value for value in values if value != sentinel]
    hit = F.coalesce(column.isin(*named), F.lit(False)) if named else F.lit(False)
    return hit | column.isNull() if sentinel in values else hit


def facet_overlaps(column: Column, values: tuple[str, ...]) -> Column:
    if not values:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])), F.lit(False))


def facet_matches(selection: Selection) -> dict[str, Column]:
    return {
        "company": facet_in(F.col("company_name"), selection.companies),
        "employment_type": facet_in_or_null(F.col("employment_type"), selection.employment_types),
        "location": facet_overlaps(F.col("locations"), selection.locations),
    }


def searched(df: DataFrame, selection: Selection) -> DataFrame:
    """Term and closed filters, before any facet."""
    return df.filter(open_only(selection.include_closed)).filter(
        search_text(selection.q, F.col("title"), F.col("company_name"))
    )


def apply_facets(df: DataFrame, selection: Selection, skip: str | None = None) -> DataFrame:
    """All facets combined with AND, optionally leaving one out."""
    for facet, match in facet_matches(selection).items():
        if facet != skip:
            df = df.filter(match)
    return df


def matching(df: DataFrame, selection: Selection) -> DataFrame:
    return apply_facets(searched(df, selection), selection)


def sort_keys(sort: str) -> list[Column]:
    """A total order: the id breaks ties of the timestamp, in the same direction."""
    keys = [F.col("created_at"), F.col("id")]
    if sort not in ("newest", "oldest"):
        raise ValueError(f"unknown sort: {sort!r}")
    return [key.desc() if sort == "newest" else key.asc() for key in keys]


def page(df: DataFrame, number: int, sort: str = "newest", size: int = PAGE_SIZE) -> DataFrame:
    """One page of an already filtered frame (a top-k, never a full sort)."""
    if number < 1:
        raise ValueError("pages start at 1")
    return df.orderBy(*sort_keys(sort)).offset((number - 1) * size).limit(size)


def page_after(
    df: DataFrame, created_at: Column, row_id: Column, sort: str = "newest", size: int = PAGE_SIZE
) -> DataFrame:
    """The page following a known last row; its cost does not grow with the depth."""
    at, rid = F.col("created_at"), F.col("id")
    if sort == "newest":
        beyond = (at < created_at) | ((at == created_at) & (rid < row_id))
        bound = at <= created_at
    else:
        beyond = (at > created_at) | ((at == created_at) & (rid > row_id))
        bound = at >= created_at
    # The plain bound is what the parquet reader can skip row groups by.
    return df.filter(bound).filter(beyond).orderBy(*sort_keys(sort)).limit(size)


def page_totals(df: DataFrame, size: int = PAGE_SIZE, approx: bool = False) -> DataFrame:
    """Total, distinct companies and last page number over the whole filtered frame."""
    companies = (
        F.approx_count_distinct("company_name") if approx else F.count_distinct("company_name")
    )
    totals = df.agg(F.count(F.lit(1)).alias("total"), companies.alias("company_count"))
    return totals.withColumn("last_page", last_page(F.col("total"), size))


def facet_sketches(df: DataFrame, precision: int = 14) -> DataFrame:
    """Per cell of facet values (open or closed, type, set of locations) its rows and a
    mergeable sketch of its companies. Cells are far fewer than rows, and any selection of
    types and locations is a union of cells."""
    places = F.array_sort(F.array_distinct("locations"))
    cells = df.groupBy(open_only(False).alias("open"), "employment_type", places.alias("locations"))
    return cells.agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("company_name", precision).alias("companies"))


def page_totals_approx(sketches: DataFrame, selection: Selection, size: int = PAGE_SIZE) -> DataFrame:
    """Totals of a selection of types and locations from the cells alone: the total is exact,
    the companies an estimate with a standard error of 1.04 / sqrt(2**precision) (0.8 % at
    the default). A term or chosen companies are no union of cells and are refused."""
    if selection.q or selection.companies:
        raise ValueError("cells know neither titles nor single companies")
    chosen = sketches if selection.include_closed else sketches.filter("open")
    match = facet_matches(selection)
    hit = chosen.filter(match["employment_type"] & match["location"])
    companies = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("companies")), F.lit(0))
    totals = hit.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"), companies.alias("company_count"))
    return totals.withColumn("last_page", last_page(F.col("total"), size))


def last_page(total: Column, size: int = PAGE_SIZE) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(total / size))


def clamp_page(number: Column, total: Column, size: int = PAGE_SIZE) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), F.least(number, last_page(total, size)))


def facet_counts(df: DataFrame, selection: Selection, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """(facet, value, count) for all facets in one scan and one shuffle.

    Each facet is narrowed by the other facets' selections, never by its own, so a row
    is emitted once per facet whose siblings it satisfies. A stated employment type also
    emits a weightless entry for the null value: that group then knows by itself whether a
    real value exists, which is what the unspecified bucket needs to be shown.
    """
    match = facet_matches(selection)

    def entry(facet: str, value: Column, weight: int = 1) -> Column:
        return F.struct(
            F.lit(facet).alias("facet"), value.cast("string").alias("value"), F.lit(weight).alias("weight")
        )

    stated = F.col("employment_type").isNotNull()
    places = F.array_distinct(F.coalesce("locations", F.array().cast("array<string>")))
    entries = {
        "company": F.array(entry("company", F.col("company_name"))),
        "employment_type": F.when(
            stated,
            F.array(
                entry("employment_type", F.col("employment_type")),
                entry("employment_type", F.lit(None), 0),
            ),
        ).otherwise(F.array(entry("employment_type", F.lit(None)))),
        "location": F.transform(places, lambda place: entry("location", place)),
    }
    none = F.array().cast("array<struct<facet:string,value:string,weight:int>>")
    emitted = []
    for facet in facets:
        siblings = F.lit(True)
        for other in FACETS:
            if other != facet:
                siblings = siblings & match[other]
        emitted.append(F.when(siblings, entries[facet]).otherwise(none))
    counts = (
        searched(df, selection)
        .select(F.explode(F.concat(*emitted)).alias("entry"))
        .groupBy("entry.facet", "entry.value")
        .agg(F.sum("entry.weight").alias("count"), F.count(F.lit(1)).alias("entries"))
    )
    shown = F.col("value").isNotNull() | ((F.col("count") > 0) & (F.col("entries") > F.col("count")))
    return counts.filter(shown).select(
        "facet", F.coalesce("value", F.lit(UNSPECIFIED)).alias("value"), "count"
    )


def ordered_facets(counts: DataFrame) -> DataFrame:
    return counts.orderBy("facet", F.col("count").desc(), F.col("value").asc())


def facet_display(counts: DataFrame, selection: Selection, k: int = 4) -> DataFrame:
    """What a collapsed facet list shows.

    The first k values by count, every selected value, and in front of them the selected
    values the counts no longer list, at count 0. `place` orders a facet's rows, `hidden`
    is the number of values left out.
    """
    spark = counts.sparkSession
    picked = [
        (facet, value, position)
        for facet in FACETS
        for position, value in enumerate(selection.wanted(facet))
    ]
    wanted = spark.createDataFrame(picked, "facet string, value string, position int")
    rank = Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value").asc())
    # row_number() <= k is cut down per task before the shuffle, so a facet with very
    # many values never gathers in one task.
    head = counts.withColumn("n", F.row_number().over(rank)).filter(F.col("n") <= k).drop("n")
    chosen = counts.join(F.broadcast(wanted.select("facet", "value")), ["facet", "value"], "left_semi")
    listed = head.unionByName(chosen).distinct()
    orphans = wanted.join(chosen, ["facet", "value"], "left_anti").select(
        "facet", "value", F.lit(0).cast("bigint").alias("count"), "position"
    )
    shown = listed.withColumn("position", F.lit(None).cast("int")).unionByName(orphans)
    sizes = counts.groupBy("facet").agg(F.count(F.lit(1)).alias("values"))
    kept = listed.groupBy("facet").agg(F.count(F.lit(1)).alias("kept"))
    hidden = sizes.join(kept, "facet").select("facet", (F.col("values") - F.col("kept")).alias("hidden"))
    # At most k + the number of selected values per facet.
    place = Window.partitionBy("facet").orderBy(
        F.col("position").asc_nulls_last(), F.col("count").desc(), F.col("value").asc()
    )
    return (
        shown.withColumn("place", F.row_number().over(place))
        .join(F.broadcast(hidden), "facet", "left")
        .select("facet", "value", "count", "place", F.coalesce("hidden", F.lit(0)).alias("hidden"))
    )


def get_posting(df: DataFrame, posting_id: str) -> DataFrame:
    """The row with that id; text that is no UUID finds nothing."""
    return df.filter(F.col("id") == uuid_or_null(F.lit(posting_id)))


def as_utc(at: Column) -> Column:
    """Explicit UTC text; stored timestamps are UTC by convention."""
    return F.date_format(at.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _shared_columns() -> list[Column]:
    none = F.array().cast("array<string>")
    return [
        F.col("id"),
        F.col("url"),
        F.col("title"),
        F.col("company_name"),
        F.col("employment_type"),
        F.coalesce("locations", none).alias("locations"),
        F.coalesce("categories", none).alias("categories"),
        F.coalesce("metadata", F.parse_json(F.lit("{}"))).alias("metadata"),
    ]


def _seen_columns() -> list[Column]:
    return [
        as_utc(F.col("created_at")).alias("first_seen"),
        as_utc(F.col("updated_at")).alias("last_seen"),
        F.col("deleted_at").isNotNull().alias("closed"),
    ]


def to_summary(df: DataFrame) -> DataFrame:
    text = snippet(F.coalesce("description", F.lit("")))
    return df.select(*_shared_columns(), text.alias("snippet"), *_seen_columns())


def to_detail(df: DataFrame) -> DataFrame:
    pay = pay_struct(F.col("pay_min"), F.col("pay_max"), F.col("pay_currency"), F.col("pay_period"))
    return df.select(
        *_shared_columns(),
        pay.alias("pay"),
        F.coalesce("description", F.lit("")).alias("description"),
        *_seen_columns(),
    )
