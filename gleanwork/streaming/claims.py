"""Claims on a stream: the hold of each key is state, and a timer ends it.

A micro-batch is judged per key in the order of (ts, seq), from the hold that earlier
batches left. Holds live in the state store, a row for each key that is held now: a release
clears it, and so does an event-time timer once the watermark has passed its end. State
written by a batch takes effect once, with the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gleanwork.operators import claims as C

JUDGED = "key string, ts timestamp, seq bigint, granted boolean"


class Holds(StatefulProcessor):
    """The hold of a key as value state, with a timer at its end."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hold = handle.getValueState("hold", "until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        events = frame.assign(ts=frame["ts"].astype("datetime64[us]").astype("int64"))
        entry = int(self.hold.get()[0]) if self.hold.exists() else C.FREE
        granted, left = C.replayed(events, self.ttl, entry)
        if left != entry:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if left == C.FREE:
                self.hold.clear()
            else:
                self.hold.update((left,))
                self.handle.registerTimer(left // 1000 + 1)
        asked = frame[~frame["release"].astype(bool)]
        yield pd.DataFrame({"key": asked["key"], "ts": asked["ts"], "seq": asked["seq"], "granted": asked["seq"].isin(granted)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hold.clear()
        return iter([])

    def close(self) -> None:
        pass


def judged_claims(events: DataFrame, ttl_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """The stream's acquire events (key, ts, seq) with `granted`.

    events(key, ts, seq, kind) is a stream. Rows without a key make no claim. An event may
    come `lateness` behind the latest one; what is later still is dropped, like all that the
    watermark has passed, and within that time keys are judged in the order of arrival of
    their batches.
    """
    narrow = events.filter(F.col("key").isNotNull()).select(
        F.col("key").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("seq").cast("bigint").alias("seq"),
        (F.col("kind") == C.RELEASE).alias("release"),
    )
    return narrow.withWatermark("ts", lateness).groupBy("key").transformWithStateInPandas(
        statefulProcessor=Holds(ttl_seconds * 1_000_000), outputStructType=JUDGED, outputMode="Append", timeMode="EventTime"
    )


def request_events(requests: DataFrame) -> DataFrame:
    """Learning requests (host, ts, seq) as attempts to claim their host."""
    return requests.select(F.col("host").alias("key"), "ts", "seq", F.lit(C.ACQUIRE).alias("kind"))


def lease_events(tasks: DataFrame) -> DataFrame:
    """Lease events (stage, domain, kind, ts, seq) by their lease's key."""
    return tasks.select(C.lease_key(F.col("stage"), F.col("domain")).alias("key"), "ts", "seq", "kind")


def start_claims(events: DataFrame, path: str, ttl_seconds: int, lateness: str = "10 minutes", trigger: dict | None = None):
    """Append the judged claims to Parquet files under `path`, beside the stream's checkpoint."""
    return (
        judged_claims(events, ttl_seconds, lateness)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/judged")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
