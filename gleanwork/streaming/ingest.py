"""The crawl stream: messages to Bronze, runs, Silver and the refusal log.

Every micro-batch is one batch of the batch operators, and only ever appends: its part of
the runs, of Bronze and of Silver, the cutoffs of the spiders whose run it ended, and its
refusals. Its items go on to Silver from the batch itself; no stored table is scanned for
their content, and closing old rows is a relation of cutoffs that readers apply. A replayed
batch replaces its own folders, so together with the stream's checkpoint each message takes
effect once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanwork import schemas
from gleanwork.functions.ids import url_key
from gleanwork.operators import bronze as B
from gleanwork.operators import rules as R
from gleanwork.operators import silver as S
from gleanwork.operators.joins import fits
from gleanwork.sources.messages import END_RUN, parse_messages
from gleanwork.sources.tables import PartsTable

_RUN_PART = "id string, seq bigint, spider_name string, started_at timestamp"
_CUTOFF = "spider_name string, cutoff timestamp, at timestamp"
_SILVER_FIELDS = [f for f in schemas.SILVER.fieldNames() if f not in ("id", "url", "created_at", "updated_at", "deleted_at")]
_SILVER_PART = ", ".join(
    [f"{f.name} {f.dataType.simpleString()}" for f in schemas.SILVER if f.name in _SILVER_FIELDS]
    + ["url string", "seen bigint", "created_at timestamp", "updated_at timestamp"]
)


def _fold_runs(parts: DataFrame) -> DataFrame:
    first = F.min_by(F.struct("spider_name", "started_at"), "seq").alias("first")
    return parts.groupBy("id").agg(first, F.min("seq").alias("seq")).select("id", "seq", "first.*")


def _fold_silver(parts: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct(*_SILVER_FIELDS, "updated_at"), "seen").alias("newest")
    folded = parts.groupBy("url").agg(newest, F.max("seen").alias("seen"), F.min("created_at").alias("created_at"))
    return folded.select("url", "seen", "created_at", "newest.*")


def _silver_rows(parts: DataFrame) -> DataFrame:
    made = {"id": url_key(F.col("url")), "deleted_at": F.lit(None).cast("timestamp")}
    return parts.select(*[made[c].alias(c) if c in made else F.col(c) for c in schemas.SILVER.fieldNames()])


@dataclass(frozen=True)
class Tables:
    """Where a pipeline keeps its state, under one shared folder."""

    bronze: PartsTable
    runs: PartsTable
    silver: PartsTable
    root: str

    @staticmethod
    def under(spark: SparkSession, root: str) -> Tables:
        return Tables(
            PartsTable(spark, f"{root}/bronze", B.PART, B.merge_parts, B.of_parts),
            PartsTable(spark, f"{root}/runs", _RUN_PART, _fold_runs, lambda runs: runs.select("id", "spider_name", "started_at")),
            PartsTable(spark, f"{root}/silver", _SILVER_PART, _fold_silver, _silver_rows),
            root,
        )


def _keep(df: DataFrame, root: str, name: str, batch: int) -> DataFrame:
    """Write an intermediate once and read it back: shared, replayable, lineage cut."""
    path = f"{root}/steps/{name}/batch={batch}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apply_messages(tables: Tables, raw: DataFrame, batch: int) -> DataFrame:
    """One batch of (seq, value) messages into runs and Bronze; returns its changed rows.

    These are Bronze rows as the batch alone shows them: complete content is the newest, and
    an item without a type counts where it made the row. Items come before the closing of the
    spiders whose run ended in the batch.
    """
    now = F.current_timestamp()
    messages = _keep(parse_messages(raw)[0], tables.root, "messages", batch)
    tables.runs.put(B.first_mentions(messages), batch)
    part = tables.bronze.put(B.fold_items(messages, now, batch), batch)
    ended = B.ended_spiders(messages, tables.runs.read(before=batch + 1))
    cutoffs = B.spider_cutoffs(tables.runs.read(before=batch + 1)).join(ended, "spider_name", "left_semi")
    has_end = not messages.filter(F.col("type") == END_RUN).isEmpty()
    rows = cutoffs if has_end else cutoffs.limit(0)
    rows.select("spider_name", "cutoff", now.alias("at")).write.mode("overwrite").parquet(f"{tables.root}/cutoffs/batch={batch}")
    complete = B.is_complete(F.col("weight"))
    typeless = part.filter(~complete)
    if not typeless.isEmpty():
        # Only urls are read: has any earlier batch stored the row?
        typeless = typeless.join(tables.bronze.parts(before=batch).select("url"), "url", "left_anti")
        part = part.filter(complete).unionByName(typeless)
    return B.of_parts(part).drop("seen")


def apply_silver(
    tables: Tables, changed: DataFrame, rules: list[R.Rule], winners: DataFrame, batch: int
) -> S.SilverBatch:
    """The batch's changed rows into Silver; refusals go to the event log.

    The plan reads the batch's own part. A refusal's board is what Bronze holds for its
    posting, which `read_events` looks up.
    """
    now = F.current_timestamp()
    result = S.silver_batch(changed, rules, winners, now, folder=f"{tables.root}/judged/batch={batch}")
    stamped = result.accepted.withColumns({"seen": F.lit(batch).cast("bigint"), "created_at": now, "updated_at": now})
    tables.silver.put(stamped, batch)
    events = result.events.withColumn("id", F.expr("uuid()"))
    # One directory per batch: a replay replaces its own events instead of adding to them.
    events.select(*schemas.INGEST_EVENTS.fieldNames()).write.mode("overwrite").parquet(f"{tables.root}/events/batch={batch}")
    return result


def read_bronze(tables: Tables) -> DataFrame:
    """Bronze with the rows closed that no kept run has seen."""
    rows = tables.bronze.read()
    try:
        cutoffs = tables.bronze.spark.read.schema(f"{_CUTOFF}, batch bigint").parquet(f"{tables.root}/cutoffs")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return rows.drop("seen")
    closed = B.closings(cutoffs, tables.runs.read())
    return B.closed_by(rows, closed, fits(closed)).select(*schemas.BRONZE.fieldNames())


def read_events(tables: Tables) -> DataFrame:
    """The refusal log, each event with the board its posting was first reached through."""
    log = tables.bronze.spark.read.schema(schemas.INGEST_EVENTS).parquet(f"{tables.root}/events").drop("batch", "start_url_id")
    boards = tables.bronze.parts().groupBy("url").agg(
        F.min_by("first_board", "first_seq").alias("first_board"), F.min_by("board", "board_seq").alias("board")
    )
    boards = boards.select(F.col("url").alias("posting_url"), F.coalesce("first_board", "board").alias("start_url_id"))
    return log.join(boards, "posting_url", "left").select(*schemas.INGEST_EVENTS.fieldNames())


def start_bronze(raw: DataFrame, tables: Tables, trigger: dict | None = None) -> StreamingQuery:
    """Run a stream of (seq, value) messages into Bronze and the run registry only."""

    def step(batch: DataFrame, batch_id: int) -> None:
        apply_messages(tables, batch, batch_id)

    return _start(raw, step, f"{tables.root}/checkpoint/bronze", trigger)


def start_ingest(
    raw: DataFrame, tables: Tables, rules: list[R.Rule], winners: DataFrame, trigger: dict | None = None
) -> StreamingQuery:
    """Run a stream of (seq, value) messages through Bronze, Silver and the event log."""

    def step(batch: DataFrame, batch_id: int) -> None:
        changed = apply_messages(tables, batch, batch_id)
        apply_silver(tables, changed, rules, winners, batch_id)

    return _start(raw, step, f"{tables.root}/checkpoint/ingest", trigger)


def _start(stream: DataFrame, step, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
