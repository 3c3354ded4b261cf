"""Bronze: run registry, keyed upsert of raw content, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.functions import documents as D
from gleanwork.functions.ids import uuid_or_null, uuid_value_or_null
from gleanwork.operators.joins import fits, lookup_join
from gleanwork.schemas import HTML_TYPE
from gleanwork.sources.messages import END_RUN, ITEM_TAG, START_RUN

KEEP_RUNS = 3
UNKNOWN_SPIDER = "unknown"


def _run_names(messages: DataFrame) -> DataFrame:
    """(run_id, seq, ts, spider_name) for every message able to register its run."""
    metadata = F.col("item.metadata")
    named = D.field(metadata, "$.spider")
    item_name = F.when(named.isNull(), F.lit(UNKNOWN_SPIDER)).otherwise(D.as_string(named))
    name = (
        F.when(F.col("type") == ITEM_TAG, item_name)
        .when(F.col("type") == END_RUN, F.coalesce("spider_name", F.lit(UNKNOWN_SPIDER)))
        .when(F.col("type") == START_RUN, F.col("spider_name"))
    )
    usable = (F.col("type") != ITEM_TAG) | (
        F.col("item").isNotNull() & (metadata.isNull() | D.entries(metadata).isNotNull())
    )
    return (
        messages.filter(usable)
        .select(uuid_or_null(F.col("run_id")).alias("id"), "seq", "ts", name.alias("spider_name"))
        .filter(F.col("id").isNotNull() & F.col("spider_name").isNotNull())
    )


def run_registry(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Runs named by the first message that mentions them; known runs stay as they are."""
    first = first_mentions(messages).select("id", "spider_name", "started_at")
    if known is None:
        return first
    return known.unionByName(first.join(known, "id", "left_anti"))


def first_mentions(messages: DataFrame) -> DataFrame:
    """(id, seq, spider_name, started_at) of each run's first message of a batch."""
    first = _run_names(messages).groupBy("id").agg(
        F.min_by(F.struct("spider_name", F.col("ts").alias("started_at")), "seq").alias("first"), F.min("seq").alias("seq")
    )
    return first.select("id", "seq", "first.*")


def item_state(messages: DataFrame) -> DataFrame:
    """Items with a `reason` column: null when storable whatever Bronze holds."""
    metadata = F.col("item.metadata")
    items = messages.filter(F.col("type") == ITEM_TAG).select(
        "seq",
        uuid_or_null(F.col("run_id")).alias("run_id"),
        F.col("run_id").alias("raw_run_id"),
        F.col("item.url").alias("url"),
        F.col("item.raw_content").alias("raw_content"),
        F.col("item.content_type").alias("content_type"),
        F.col("item.source_url").alias("source_url"),
        metadata.alias("metadata"),
        uuid_value_or_null(F.col("item.start_url_id")).alias("start_url_id"),
        F.col("item").isNull().alias("no_item"),
    )
    return items.withColumn(
        "reason",
        F.when(F.col("no_item") | F.col("raw_run_id").isNull() | (F.col("raw_run_id") == ""), "no_item_or_run")
        .when(F.col("run_id").isNull(), "bad_run_id")
        .when(F.col("metadata").isNotNull() & D.entries(F.col("metadata")).isNull(), "bad_metadata")
        .when(F.col("url").isNull() | (F.col("url") == ""), "no_url")
        .when(F.col("raw_content").isNull(), "no_raw_content")
        .when(F.col("source_url").isNull(), "no_source_url"),
    ).drop("no_item", "raw_run_id")


# What items amount to for a url, as a row that merges with others of its url. `weight` picks
# the body: the newest complete item, else the oldest storable one, which may lack a content
# type and can then only insert. `seen` is the batch it came in.
PART = (
    "url string, weight bigint, seen bigint, raw_content string, content_type string, source_url string, metadata variant,"
    " run_id string, first_seq bigint, first_board string, board_seq bigint, board string, created_at timestamp, changed_at timestamp"
)
_BODY = ("seen", "raw_content", "content_type", "source_url", "metadata", "run_id", "changed_at")
# Incomplete items weigh less than nothing, the older the more.
_INCOMPLETE = -(2**62)


def fold_items(messages: DataFrame, now: Column, batch: int = 0) -> DataFrame:
    """One part row per url of a batch. Partial aggregates, so a url repeated in a third of
    the messages reaches the shuffle once per task, with one body."""
    complete = F.col("content_type").isNotNull()
    storable = item_state(messages).filter(F.col("reason").isNull())
    return merge_parts(
        storable.select(
            "url",
            F.when(complete, F.col("seq")).otherwise(_INCOMPLETE - F.col("seq")).alias("weight"),
            F.lit(batch).cast("bigint").alias("seen"),
            "raw_content", "content_type", "source_url", "metadata", "run_id",
            F.col("seq").alias("first_seq"), F.col("start_url_id").alias("first_board"),
            F.when(complete & F.col("start_url_id").isNotNull(), F.col("seq")).alias("board_seq"),
            F.col("start_url_id").alias("board"),
            now.alias("created_at"), now.alias("changed_at"),
        )
    )


def merge_parts(parts: DataFrame) -> DataFrame:
    """Part rows folded to one per url: associative, and the same in any order."""
    merged = parts.groupBy("url").agg(
        F.max_by(F.struct(*_BODY), "weight").alias("body"), F.max("weight").alias("weight"),
        F.min_by("first_board", "first_seq").alias("first_board"), F.min("first_seq").alias("first_seq"),
        F.min_by("board", "board_seq").alias("board"), F.min("board_seq").alias("board_seq"), F.min("created_at").alias("created_at"),
    )
    return merged.select("url", "weight", *[f"body.{c}" for c in _BODY], "first_seq", "first_board", "board_seq", "board", "created_at")


def is_complete(weight: Column) -> Column:
    return weight > _INCOMPLETE


def of_parts(parts: DataFrame) -> DataFrame:
    """Folded part rows as open Bronze rows, with the batch each was last seen in."""
    return parts.select(
        "url", "raw_content", F.coalesce("content_type", F.lit(HTML_TYPE)).alias("content_type"), "source_url",
        F.coalesce("metadata", F.parse_json(F.lit("{}"))).alias("metadata"), F.col("run_id").alias("last_seen_run_id"),
        F.coalesce("first_board", "board").alias("start_url_id"), "created_at", F.col("changed_at").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("deleted_at"), "seen",
    )


def bronze_upsert(bronze: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    """The Bronze table after a batch of messages.

    Content, type, source, metadata and run are last-writer-wins; the board is
    first-writer-wins; a closed row seen again is open again; rows nothing was said about
    pass through.
    """
    known = bronze.select("url", F.struct(*[c for c in bronze.columns if c != "url"]).alias("old"))
    fresh = F.struct("weight", *_BODY, "first_board", "board")
    joined = known.join(fold_items(messages, now).select("url", fresh.alias("new")), "url", "full_outer")
    exists = F.col("old").isNotNull()
    # An incomplete item inserts a row, but changes none.
    touched = F.col("new").isNotNull() & (~exists | is_complete(F.col("new.weight")))
    empty = F.parse_json(F.lit("{}"))

    def latest(name: str, default: Column | None = None) -> Column:
        value = F.col("new")[name]
        value = value if default is None else F.coalesce(value, default)
        return F.when(F.col("touched"), value).otherwise(F.col("old")[name]).alias(name)

    board = F.when(F.col("exists"), F.coalesce("old.start_url_id", "new.board")).otherwise(F.coalesce("new.first_board", "new.board"))
    return joined.withColumns({"exists": exists, "touched": touched}).select(
        "url",
        latest("raw_content"),
        latest("content_type", F.lit(HTML_TYPE)),
        latest("source_url"),
        latest("metadata", empty),
        F.when(F.col("touched"), F.col("new.run_id")).otherwise(F.col("old.last_seen_run_id")).alias("last_seen_run_id"),
        F.when(F.col("touched"), board).otherwise(F.col("old.start_url_id")).alias("start_url_id"),
        F.coalesce("old.created_at", now).alias("created_at"),
        F.when(F.col("touched"), now).otherwise(F.col("old.updated_at")).alias("updated_at"),
        F.when(~F.col("touched"), F.col("old.deleted_at")).alias("deleted_at"),
    )


def bronze_rejects(bronze: DataFrame, messages: DataFrame) -> DataFrame:
    """(seq, url, reason) of the items a batch does not store."""
    state = item_state(messages)
    refused = state.filter(F.col("reason").isNotNull()).select("seq", "url", "reason")
    typeless = state.filter(F.col("reason").isNull() & F.col("content_type").isNull())
    # The default type only applies to an insert: the url's first storable item.
    inserts = (
        state.filter(F.col("reason").isNull())
        .groupBy("url")
        .agg(F.min("seq").alias("seq"))
        .join(bronze.select("url"), "url", "left_anti")
    )
    updates = typeless.join(inserts, ["url", "seq"], "left_anti").select(
        "seq", "url", F.lit("no_content_type").alias("reason")
    )
    return refused.unionByName(updates)


def changed_urls(messages: DataFrame) -> DataFrame:
    """The urls whose Silver row is due again, each once per batch."""
    return item_state(messages).filter(F.col("reason").isNull()).select("url").distinct()


def spider_cutoffs(runs: DataFrame, keep: int = KEEP_RUNS) -> DataFrame:
    """(spider_name, cutoff): start of the keep-th newest run; spiders with fewer than
    keep + 1 runs are left out.
    """
    newest = Window.partitionBy("spider_name").orderBy(F.col("started_at").desc())
    # Ranks past keep + 1 are dropped per task before the shuffle.
    recent = runs.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= keep + 1)
    return (
        recent.groupBy("spider_name")
        .agg(
            F.max("n").alias("runs"),
            F.max(F.when(F.col("n") == keep, F.col("started_at"))).alias("cutoff"),
        )
        .filter(F.col("runs") == keep + 1)
        .select("spider_name", "cutoff")
    )


def expired_runs(runs: DataFrame, ended: DataFrame | None = None, keep: int = KEEP_RUNS) -> DataFrame:
    """Ids of runs older than their spider's cutoff, for the spiders that just ended."""
    cutoffs = spider_cutoffs(runs, keep)
    if ended is not None:
        cutoffs = cutoffs.join(ended.select("spider_name").distinct(), "spider_name", "left_semi")
    return (
        runs.join(cutoffs, "spider_name")
        .filter(F.col("started_at") < F.col("cutoff"))
        .select("id")
    )


def tombstone(
    bronze: DataFrame, runs: DataFrame, now: Column, ended: DataFrame | None = None, keep: int = KEEP_RUNS
) -> DataFrame:
    """Close live rows last seen by a run older than the spider's kept ones."""
    old = expired_runs(runs, ended, keep).select(
        F.col("id").alias("last_seen_run_id"), F.lit(True).alias("__old")
    )
    # Counting the old runs reads the small run table only, whereas shuffling Bronze by run
    # would move the whole table and pile up the rows of the newest runs.
    marked = lookup_join(bronze, old, ["last_seen_run_id"], "left", ["url"], fits(old))
    return marked.withColumn(
        "deleted_at",
        F.when(F.col("deleted_at").isNull() & F.col("__old"), now).otherwise(F.col("deleted_at")),
    ).select(bronze.columns)


def closings(cutoffs: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, closed): for each run that some cutoff made old, the (batch, at) of those
    cutoffs in their order. cutoffs(spider_name, cutoff, batch, at), a row for each spider and
    batch that ended one of its runs."""
    old = runs.join(cutoffs, "spider_name").filter(F.col("started_at") < F.col("cutoff"))
    return old.groupBy(F.col("id").alias("run_id")).agg(F.sort_array(F.collect_list(F.struct("batch", "at"))).alias("closed"))


def closed_by(rows: DataFrame, closed: DataFrame, small_fits: bool | None = None) -> DataFrame:
    """Bronze rows (with `seen`) as the cutoffs leave them: a row is closed by the first one
    that made its run old in the batch it was last seen in, or later."""
    marked = lookup_join(rows, closed.withColumnRenamed("run_id", "last_seen_run_id"), ["last_seen_run_id"], "left", ["url"], small_fits)
    later = F.filter("closed", lambda c: c["batch"] >= F.col("seen"))
    return marked.withColumn("deleted_at", F.coalesce("deleted_at", F.get(later, F.lit(0))["at"])).drop("closed", "seen")


def ended_spiders(messages: DataFrame, runs: DataFrame) -> DataFrame:
    """Spiders with an end message, by the name their run is registered under."""
    ends = messages.filter(F.col("type") == END_RUN).select(uuid_or_null(F.col("run_id")).alias("id"))
    return runs.join(ends.distinct(), "id", "left_semi").select("spider_name").distinct()


def run_outcome(log: DataFrame) -> DataFrame:
    """(run_id, exit_code, reason) from (run_id, kind) rows, kind `item` or `error`.

    A crawl lists everything every time, so no items is a failure, not "nothing new".
    """
    counts = log.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "item").alias("items"),
        F.count_if(F.col("kind") == "error").alias("errors"),
    )
    failed = (F.col("items") == 0) | (F.col("errors") > 0)
    return counts.select(
        "run_id",
        F.when(failed, F.lit(1)).otherwise(F.lit(0)).alias("exit_code"),
        F.when(F.col("items") == 0, F.lit("no items scraped"))
        .when(F.col("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" error(s) logged")))
        .otherwise(F.lit("ok"))
        .alias("reason"),
    )
