"""The crawl message stream and the item envelope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.operators.joins import pinned
from gleanwork.schemas import HTML_TYPE, ITEM, JSON_TYPE

# The message tags.
START_RUN = "START_RUN"
ITEM_TAG = "ITEM"
END_RUN = "END_OF_RUN"

_WIRE = f"type STRING, run_id STRING, spider_name STRING, timestamp DOUBLE, item STRUCT<{ITEM}>"


def parse_messages(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split (seq, value) JSON messages into parsed ones and rejects with a reason."""
    # Parsed once: the filters and columns below all read what is pinned.
    parsed = pinned(
        raw.select("seq", "value"),
        m=F.from_json("value", _WIRE, {"mode": "PERMISSIVE"}),
        is_json=F.try_parse_json("value").isNotNull(),
    )
    known = F.col("m.type").isin(START_RUN, ITEM_TAG, END_RUN)
    # A time no timestamp can hold makes the message malformed, not the job fail.
    micros = (F.col("m.timestamp") * 1000000).try_cast("bigint")
    lost = F.col("m.timestamp").isNotNull() & micros.isNull()
    reason = F.when(~F.col("is_json") | lost, "malformed").when(~F.coalesce(known, F.lit(False)), "unknown_type")
    judged = parsed.withColumn("reason", reason)
    messages = judged.filter(F.col("reason").isNull()).select(
        "seq",
        "m.type",
        "m.run_id",
        "m.spider_name",
        F.timestamp_micros(micros).alias("ts"),
        "m.item",
    )
    return messages, judged.filter(F.col("reason").isNotNull()).select("seq", "reason", "value")


def envelope(
    url: Column, content: Column, source_url: Column, content_type: Column,
    start_url_id: Column, spider: str, metadata: dict[str, Column] | None = None,
) -> Column:
    """The item every crawler stage emits."""
    extra = [value.alias(name) for name, value in (metadata or {}).items()]
    return F.struct(
        url.alias("url"),
        content.alias("raw_content"),
        content_type.alias("content_type"),
        source_url.alias("source_url"),
        start_url_id.cast("variant").alias("start_url_id"),
        F.to_variant_object(F.struct(F.lit(spider).alias("spider_name"), *extra)).alias("metadata"),
    )


def posting_items(refs: DataFrame, spider: str) -> DataFrame:
    """One item per in-hand posting document; the source is the feed it came from."""
    return refs.filter(F.col("document").isNotNull()).select(
        envelope(
            F.col("url"), F.to_json("document"), F.col("response_url"), F.lit(JSON_TYPE),
            F.col("start_url_id"), spider,
        ).alias("item")
    )


def page_items(pages: DataFrame, spider: str) -> DataFrame:
    """One item per fetched posting page, with the media type its header names."""
    from gleanwork.functions.urls import bare_media_type

    kind = bare_media_type(F.col("content_type")) if "content_type" in pages.columns else F.lit(HTML_TYPE)
    start = F.col("start_url_id") if "start_url_id" in pages.columns else F.lit(None).cast("string")
    return pages.select(
        envelope(F.col("url"), F.col("html"), F.col("url"), kind, start, spider).alias("item")
    )
