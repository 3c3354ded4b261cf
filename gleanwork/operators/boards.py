"""Boards: which to crawl, what they yielded, and changes to them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.functions.urls import strip_filter_params
from gleanwork.operators.joins import fits, lookup_join
from gleanwork.operators.steps import written
from gleanwork.schemas import BOARD_API, BOARD_TYPES


def active_boards(boards: DataFrame) -> DataFrame:
    return boards.filter(F.col("active") & F.col("type").isin(*BOARD_TYPES)).orderBy("name")


def active_board_counts(boards: DataFrame) -> DataFrame:
    """How many boards drive a crawl, out of how many; none means nothing to do."""
    usable = F.col("active") & F.col("type").isin(*BOARD_TYPES)
    return boards.agg(
        F.count(F.lit(1)).alias("configured"), F.count_if(usable).alias("active")
    ).withColumn("nothing_to_do", F.col("active") == 0)


def plan_requests(boards: DataFrame) -> DataFrame:
    """The address to fetch per board; an API board's filters never leave the system."""
    api = F.col("type") == BOARD_API
    return boards.select(
        F.col("id").alias("start_url_id"),
        F.col("url").alias("stored_url"),
        "type",
        F.when(api, strip_filter_params(F.col("url"))).otherwise(F.col("url")).alias("request_url"),
    )


def board_posting_counts(boards: DataFrame, bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """boards plus posting_count: null without any Bronze row, else the number of
    distinct live Silver rows reached through it.

    Bronze joins Silver on the natural key and is then counted per board, so a board
    holding most postings is spread by url and meets itself only as partial counts. The
    url is unique on both sides, so no Silver row is met twice and plain counts are distinct.
    """
    attributed = bronze.filter(F.col("start_url_id").isNotNull()).select("url", "start_url_id")
    live = silver.filter(F.col("deleted_at").isNull()).select("url", F.col("id").alias("silver_id"))
    counts = (
        attributed.join(live, "url", "left")
        .groupBy("start_url_id")
        .agg(F.count("silver_id").alias("posting_count"))
    )
    return boards.join(counts, boards["id"] == counts["start_url_id"], "left").drop("start_url_id")


def blank(column: Column) -> Column:
    return column.isNull() | (F.regexp_replace(column, r"(?U)\s+", "") == "")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of a column declared unique that occur more than once."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def conflicting_boards(candidates: DataFrame, boards: DataFrame) -> DataFrame:
    """Candidates sharing a name or an address with a different board.

    Two equi joins against the distinct holders of each key, in place of one join on an
    OR. A key's holders collapse to their count and one id first, which is all it takes
    to tell "somebody else" from "only myself" and keeps pairs from multiplying.
    """

    def taken(key: str) -> DataFrame:
        holders = boards.groupBy(key).agg(
            F.min("id").alias("__low"), F.max("id").alias("__high")
        )
        joined = candidates.join(holders, key)
        other = ~(F.col("__low").eqNullSafe(F.col("id")) & F.col("__high").eqNullSafe(F.col("id")))
        return joined.filter(other).select(candidates.columns)

    return taken("name").unionByName(taken("url")).distinct()


BOARD_COLUMNS = ("id", "name", "url", "type", "active", "created_at", "updated_at")
_CHANGE = ("seq", "op", "id", "name", "url", "type", "active")


def _marked(mark: str, column: str) -> Column:
    return F.concat(F.lit(mark), F.col(column))


def apply_board_changes(
    boards: DataFrame, changes: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Apply changes in the order of `seq`; returns the new boards and the refused changes.

    changes(seq, op, id, name, url, type, active) with op create, update or delete, as many
    per board as there are. Each is judged by the boards as the accepted ones before it left
    them: a refused change leaves no trace, a deleted or renamed board frees its name and
    address. A create without an id gets one made from its seq; an update or delete without
    an id finds nothing.

    What no state can save (a blank name or address, an unknown type) is refused at once.
    The rest is settled in rounds. A change depends on earlier open ones that touch its id,
    its name or address, or those its board holds now. Without such it is decided; and it is
    refused already when a board that no earlier open change may alter stands in its way.
    So a name that half of all changes want takes as many rounds as it changes hands, not a
    round for each change. Every step is a join or an aggregate by key, written to the shared
    folder; no group of dependent changes ever meets in one task.
    """
    made = F.concat(F.lit("board-"), F.substring(F.sha2(F.col("seq").cast("string"), 256), 1, 32))
    asked = changes.select(
        F.col("seq").cast("long").alias("seq"), "op", F.when(F.col("op") == "create", F.coalesce("id", made)).otherwise(F.col("id")).alias("id"),
        "name", "url", "type", "active",
        F.when((F.col("op") == "create") & ~F.coalesce(F.col("type").isin(*BOARD_TYPES), F.lit(False)), "unknown_type")
        .when((F.col("op") != "delete") & (blank(F.col("name")) | blank(F.col("url"))), "blank")
        .alias("refusal"),
    )
    asked = written(asked)
    refused = [asked.filter("refusal is not null")]
    open_changes = asked.filter("refusal is null").select(*_CHANGE)
    # Only boards that a change names can alter; the others are not read again.
    wanted = written(open_changes.select(F.explode(_own_keys()).alias("key")).distinct())
    held = boards.select("id", F.explode(F.array(_marked("i", "id"), _marked("n", "name"), _marked("u", "url"))).alias("key"))
    touched = written(held.join(wanted, "key", "left_semi").select("id").distinct())
    state = written(
        boards.join(touched, "id", "left_semi").select(
            "id", "name", "url", "type", "active", F.col("created_at").cast("timestamp").alias("created_at"),
            F.col("updated_at").cast("timestamp").alias("updated_at"), F.lit(False).alias("touched"),
        )
    )
    while True:
        judged = written(_judged(open_changes, state))
        decided = judged.filter("verdict is not null")
        if decided.isEmpty():
            break
        refused.append(decided.filter("verdict <> 'accepted'").withColumnRenamed("verdict", "refusal"))
        state = written(_after(state, decided.filter("verdict = 'accepted'")))
        open_changes = judged.filter("verdict is null").select(*_CHANGE)
    settled = state.select(
        "id", "name", "url", "type", "active",
        F.coalesce("created_at", now).alias("created_at"), F.when(F.col("touched"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    merged = boards.join(touched, "id", "left_anti").select(*BOARD_COLUMNS).unionByName(settled)
    columns = ("seq", "op", "id", "name", "url", "refusal")
    return merged, functools.reduce(DataFrame.unionByName, [r.select(*columns) for r in refused])


def _own_keys() -> Column:
    """What a change names: its id, and the name and address it wants."""
    wants = F.col("op") != "delete"
    return F.array_compact(F.array(_marked("i", "id"), F.when(wants, _marked("n", "name")), F.when(wants, _marked("u", "url"))))


def _judged(open_changes: DataFrame, state: DataFrame) -> DataFrame:
    """The open changes with `verdict`: accepted, why refused, or null for not yet decided."""
    mine = state.select(
        "id", F.col("name").alias("held_name"), F.col("url").alias("held_url"), F.col("type").alias("held_type"),
        F.col("active").alias("held_active"), "created_at", F.lit(True).alias("held"),
    )
    known = open_changes.join(mine, "id", "left")
    keys = F.array_distinct(F.concat(_own_keys(), F.array_compact(F.array(_marked("n", "held_name"), _marked("u", "held_url")))))
    touches = known.select("seq", F.explode(keys).alias("key"))
    firsts = written(touches.groupBy("key").agg(F.min("seq").alias("first")))
    at = touches.join(firsts, "key").groupBy("seq").agg(
        F.bool_and(F.col("first") == F.col("seq")).alias("free"),
        F.bool_and(~F.col("key").startswith("i") | (F.col("first") == F.col("seq"))).alias("id_free"),
    )
    # Who has the name and the address, and from when on an open change may alter that board.
    alters = firsts.filter(F.col("key").startswith("i")).select(F.expr("substring(key, 2)").alias("id"), "first")
    holders = state.join(alters, "id", "left")
    for key in ("name", "url"):
        holder = holders.select(F.col(key), F.col("id").alias(f"{key}_holder"), F.col("first").alias(f"{key}_until"))
        known = known.join(holder, key, "left")

    def taken(key: str, firmly: bool) -> Column:
        other = F.col(f"{key}_holder").isNotNull() & ~F.col(f"{key}_holder").eqNullSafe(F.col("id"))
        return other & F.coalesce(F.col(f"{key}_until") > F.col("seq"), F.lit(True)) if firmly else other

    found = known.join(at, "seq", "left")
    # Without any key (no id, nothing wanted) a change depends on nothing.
    free, id_free = F.coalesce("free", F.lit(True)), F.coalesce("id_free", F.lit(True))
    missing = F.col("held").isNull()
    in_the_way = F.when(free, taken("name", False) | taken("url", False)).otherwise(taken("name", True) | taken("url", True))
    create, delete = F.col("op") == "create", F.col("op") == "delete"
    verdict = (
        F.when(create & ((id_free & ~missing) | in_the_way), "duplicate")
        .when(~create & id_free & missing, "not_found")
        .when(~create & ~delete & id_free & (F.col("type") != F.col("held_type")), "type_is_fixed")
        .when(~create & ~delete & id_free & in_the_way, "duplicate")
        .when(free, "accepted")
    )
    return found.select(*_CHANGE, "held_type", "held_active", "created_at", verdict.alias("verdict"))


def _after(state: DataFrame, accepted: DataFrame) -> DataFrame:
    """The boards after changes of which no two touch the same one."""
    put = accepted.filter("op <> 'delete'").select(
        "id", "name", "url", F.coalesce("held_type", "type").alias("type"), F.coalesce("active", "held_active", F.lit(True)).alias("active"),
        "created_at", F.lit(None).cast("timestamp").alias("updated_at"), F.lit(True).alias("touched"),
    )
    return state.join(accepted.select("id"), "id", "left_anti").unionByName(put)


def detach_deleted_boards(rows: DataFrame, deleted: DataFrame, spread_by: list[str]) -> DataFrame:
    """Bronze rows or events whose board is gone lose the reference to it."""
    gone = deleted.select(F.col("id").alias("start_url_id"), F.lit(True).alias("__gone")).distinct()
    return (
        lookup_join(rows, gone, ["start_url_id"], "left", spread_by, fits(gone))
        .withColumn("start_url_id", F.when(F.col("__gone").isNull(), F.col("start_url_id")))
        .select(rows.columns)
    )
