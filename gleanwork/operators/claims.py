"""Claims with a time to live, evaluated exactly and in parallel.

A claim on a key holds until its TTL runs out or it is released; an attempt meanwhile is
refused and changes nothing. Who gets a claim depends on all earlier grants, so a naive
job walks each key's history in one task.

Here all events are put in one global order and cut into runs of bounded size. What a run
does to a key's claim is a step function of the state it is entered with ("held until t", or
free), and such functions form a monoid. They are composed in pairs, pairs of pairs and so
on, up a tree; then the states with which its halves are entered are handed down, and all
runs are replayed at once. A function is kept in pieces of at most a run's steps. Two
functions are composed piece by piece, where the states one leaves with meet the states the
other is entered with, so no task ever holds more than two pieces, however busy a key is.
Only entry states that can occur, up to a TTL past a span's first event, are followed;
functions stay as small as one TTL's events, and the levels of the tree shrink.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.operators.steps import in_runs, written

ACQUIRE, RELEASE = "acquire", "release"
REQUEST_TTL_SECONDS = 1800
LEASE_TTL_SECONDS = 1800
# Events that one task looks at together.
CHUNK_ROWS = 200_000
FREE = -(2**62)
_FOREVER = 2**62


class _Chunk:
    """Vectorised view of one chunk's events in order."""

    def __init__(self, frame, ttl: int) -> None:
        import numpy as np

        frame = frame.sort_values(["ts", "seq"], kind="stable")
        self.seq = frame["seq"].to_numpy()
        ts = frame["ts"].to_numpy()
        release = frame["release"].to_numpy(dtype=bool)
        self.count = len(ts)
        self.places = np.flatnonzero(~release)  # of acquires among all events
        self.releases = np.flatnonzero(release)
        self.at = ts[self.places]
        self.total = len(self.places)
        self.ttl = ttl
        # Per acquire, were it granted: the acquire granted next, `total` for none.
        due = np.searchsorted(self.at, self.at + ttl, side="left")
        freed = self._next_release(self.places)
        self.next, self.freed = self._after(due, freed)

    def _next_release(self, places):
        import numpy as np

        found = np.searchsorted(self.releases, places, side="right")
        padded = np.append(self.releases, self.count)
        return padded[found]

    def _after(self, due, freed):
        """(next granted acquire, whether a release came before it)."""
        import numpy as np

        due_place = np.append(self.places, self.count)[due]
        by_release = freed < due_place
        resumed = np.searchsorted(self.places, freed, side="right")
        return np.where(by_release, resumed, due), by_release

    def exits(self):
        """State after the chunk for each acquire, were it granted (pointer doubling)."""
        import numpy as np

        state = np.append(np.where(self.freed, FREE, self.at + self.ttl), FREE)
        jump = np.append(self.next, self.total)
        last = np.where(jump >= self.total, np.arange(self.total + 1), jump)
        while True:
            further = last[last]
            if (further == last).all():
                return state[last][: self.total]
            last = further

    def first(self, entry: int) -> tuple[int, bool]:
        """(first acquire granted when entered with a state, whether a release freed it)."""
        import numpy as np

        due = np.array([np.searchsorted(self.at, entry, side="left")])
        freed = np.array([self.releases[0] if len(self.releases) else self.count])
        following, by_release = self._after(due, freed)
        return int(following[0]), bool(by_release[0])

    def granted(self, entry: int) -> list[int]:
        found = []
        place, _ = self.first(entry)
        while place < self.total:
            found.append(int(self.seq[self.places[place]]))
            place = int(self.next[place])
        return found

    def steps(self) -> list[tuple[int, int]]:
        """The chunk as a step function: (entered with a state up to, left with)."""
        import numpy as np

        exits = self.exits()
        if len(self.releases):
            # Whatever the chunk is entered with, its first release leaves it free.
            following, _ = self.first(_FOREVER)
            return [(_FOREVER, int(exits[following]) if following < self.total else FREE)]
        runs = np.append(np.flatnonzero(np.diff(exits)), self.total - 1)
        return [(int(self.at[i]), int(exits[i])) for i in runs]


def replayed(frame, ttl: int, entry: int) -> tuple[list[int], int]:
    """The granted seqs of one key's events (ts in micros, seq, release) entered with a state,
    and the state they leave."""
    chunk = _Chunk(frame, ttl)
    granted = chunk.granted(entry)
    for upto, left in chunk.steps():
        if entry <= upto:
            return granted, left
    return granted, entry


_PIECE = "key string, span bigint, first bigint, reach bigint, low bigint, high bigint, upto array<bigint>, left array<bigint>"


def _steps(ttl: int):
    """A run's function in pieces: of the states above `low` up to `high`, those up to upto[i]
    (and above the one before) leave with left[i]; later states pass unchanged.

    In a piece, states never leave with less than earlier ones. A later start ends earlier
    only where its chain has a grant less, which within a TTL happens once.
    """

    def run(frame):
        import numpy as np
        import pandas as pd

        one = frame.iloc[0]
        upto, left = map(np.array, zip(*_Chunk(frame, ttl).steps(), strict=True))
        held = int(np.searchsorted(upto, one["first"] + one["reach"])) + 1
        upto, left = upto[:held], left[:held]
        edges = [0, *(np.flatnonzero(np.diff(left) < 0) + 1).tolist(), len(upto)]
        low, pieces = FREE - 1, []
        for i, j in zip(edges, edges[1:], strict=False):
            pieces.append((one["key"], one["span"], one["first"], one["reach"], low, upto[j - 1], upto[i:j], left[i:j]))
            low = upto[j - 1]
        return pd.DataFrame(pieces, columns=["key", "span", "first", "reach", "low", "high", "upto", "left"])

    return run


def _joined(batches):
    """For each meeting of two pieces, the states of the left one that go through the right."""
    import numpy as np
    import pyarrow as pa

    names = ["key", "span", "first", "reach", "low", "high", "upto", "left"]
    longs = pa.list_(pa.int64())
    types = [pa.string(), *[pa.int64()] * 5, longs, longs]
    for batch in batches:
        out = []
        lists = [batch.column(name) for name in ("upto", "left", "right_upto", "right_left")]
        plain = batch.select(["key", "span", "first", "reach", "low", "right_low", "right_high"]).to_pylist()
        for at, row in enumerate(plain):
            upto, left, right_upto, right_left = (np.asarray(column[at].values) for column in lists)
            i, j = np.searchsorted(left, [row["right_low"], row["right_high"]], side="right").tolist()
            if i == j:
                continue
            low = row["low"] if i == 0 else int(upto[i - 1])
            upto, left = upto[i:j], left[i:j]
            if len(right_upto):
                left = right_left[np.searchsorted(right_upto, left, side="left")]
            last = np.append(np.flatnonzero(np.diff(left)), len(left) - 1)
            out.append((row["key"], row["span"], row["first"], row["reach"], low, int(upto[-1]), upto[last], left[last]))
        yield pa.RecordBatch.from_arrays([pa.array([r[at] for r in out], kind) for at, kind in enumerate(types)], names)


def _composed(pieces: DataFrame, spans: DataFrame) -> DataFrame:
    """The functions of neighbouring spans as those of their parents.

    `spans` (key, span, high) holds each function's last entry state of its own; states
    above it pass the function unchanged.
    """
    parent = F.floor(F.col("span") / 2).alias("span")
    is_right = F.col("span") % 2 == 1
    right_spans = spans.filter(is_right).select("key", parent, F.col("high").alias("right_end"))
    lefts = pieces.filter(~is_right).withColumn("parent", F.floor(F.col("span") / 2))
    rights = pieces.filter(is_right).select("key", parent, "low", "high", "upto", "left")
    passing = right_spans.select("key", "span", F.col("right_end").alias("low"), F.lit(_FOREVER).alias("high"), F.array().cast("array<bigint>").alias("upto"), F.array().cast("array<bigint>").alias("left"))
    met = rights.unionByName(passing).select(
        "key", F.col("span").alias("parent"), F.col("low").alias("right_low"), F.col("high").alias("right_high"), F.col("upto").alias("right_upto"), F.col("left").alias("right_left")
    )
    inside = (F.get("left", F.lit(0)) <= F.col("right_high")) & (F.element_at("left", -1) > F.col("right_low"))
    crossing = lefts.join(met, ["key", "parent"]).filter(inside).drop("span").withColumnRenamed("parent", "span")
    joined = crossing.mapInArrow(_joined, _PIECE)
    # States that the left function passes on unchanged go through the right one alone.
    left_spans = spans.filter(~is_right).select("key", parent, F.col("high").alias("left_end"))
    starts = pieces.filter(~is_right).groupBy("key", parent).agg(F.min("first").alias("first"), F.min("reach").alias("reach"))
    behind = rights.join(left_spans.join(starts, ["key", "span"]), ["key", "span"]).withColumn("low", F.greatest("low", "left_end"))
    behind = behind.filter((F.col("low") < F.col("high")) & (F.col("low") < F.col("reach") + F.col("first")))
    columns = ["key", "span", "first", "reach", "low", "high", "upto", "left"]
    alone = lefts.join(right_spans.withColumnRenamed("span", "parent").drop("right_end"), ["key", "parent"], "left_anti")
    # A key of one span is done: nothing above needs its function.
    alone = alone.filter("parent > 0").drop("span").withColumnRenamed("parent", "span")
    return joined.unionByName(behind.select(*columns)).unionByName(alone.select(*columns))


def _entries(events: DataFrame, start: DataFrame, ttl: int) -> DataFrame:
    """(key, chunk, entry): the state in which each run of each key is entered.

    events(key, chunk, ts, seq, release); start(key, initial).
    """
    # One narrow row for each run and key; a key's spans are its runs in order.
    held = events.groupBy("key", "chunk").agg(F.min("ts").alias("first"))
    along = Window.partitionBy("key").orderBy("chunk")
    whole = Window.partitionBy("key")
    numbered = held.select("key", "chunk", "first", (F.row_number().over(along) - 1).cast("bigint").alias("span"), F.count("*").over(whole).alias("spans"), F.min("first").over(whole).alias("key_first"))
    initial = F.coalesce("initial", F.lit(FREE).cast("bigint")).alias("entry")
    chunks = written(numbered.join(start, "key", "left").select("key", "chunk", "first", "span", "spans", "key_first", initial))
    busy = chunks.filter("spans > 1")
    most = busy.agg(F.max("spans")).first()[0] or 1
    # No state is later than a TTL past a grant, but for one given from outside.
    reach = F.greatest(F.lit(ttl), F.col("entry") - F.col("key_first")).alias("reach")
    mine = events.join(busy.select("key", "chunk", "first", "span", reach), ["key", "chunk"])
    pieces = written(mine.groupBy("key", "chunk").applyInPandas(_steps(ttl), _PIECE)) if most > 1 else None
    levels = []
    while most > 1:
        spans = written(pieces.groupBy("key", "span").agg(F.max("high").alias("high")))
        levels.append((pieces, spans))
        most = -(-most // 2)
        if most > 1:
            pieces = written(_composed(pieces, spans))
    states = written(busy.filter("span = 0").select("key", "span", "entry")) if levels else None
    for pieces, spans in reversed(levels):
        lefts = states.withColumn("span", F.col("span") * 2)
        rights = spans.select("key", (F.col("span") - 1).alias("span"))
        found = pieces.select("key", "span", "low", "high", "upto", "left")
        asked = lefts.join(rights, ["key", "span"], "left_semi")
        passed = asked.join(found, ["key", "span"]).filter((F.col("entry") > F.col("low")) & (F.col("entry") <= F.col("high")))
        at = F.size(F.filter("upto", lambda u: u < F.col("entry")))
        moved = passed.select("key", "span", F.get("left", at).alias("moved"))
        onward = asked.join(moved, ["key", "span"], "left").select("key", (F.col("span") + 1).alias("span"), F.coalesce("moved", "entry").alias("entry"))
        states = written(lefts.unionByName(onward))
    calm = chunks.filter("spans = 1").select("key", "chunk", "entry")
    if states is None:
        return calm
    return calm.unionByName(busy.drop("entry").join(states, ["key", "span"]).select("key", "chunk", "entry"))


def _replay(ttl: int):
    def run(key, frame):
        import pandas as pd

        granted = _Chunk(frame, ttl).granted(int(frame["entry"].iloc[0]))
        return pd.DataFrame({"key": key[0], "seq": granted}).astype({"seq": "int64"})

    return run


def granted_claims(
    events: DataFrame, ttl_seconds: int, initial: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """(key, seq) of the acquire events that get their claim.

    events(key STRING, ts TIMESTAMP, seq BIGINT, kind): kind `acquire` or `release`, seq
    orders events of one instant. initial(key, held_until TIMESTAMP) is the state to start
    from. Only narrow columns are shuffled, and no task sees more of a key than one run of
    `chunk_rows` events, or two pieces of that size.
    """
    ttl = ttl_seconds * 1_000_000
    narrow = events.filter(F.col("key").isNotNull()).select(
        F.col("key").cast("string").alias("key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("seq").cast("bigint").alias("seq"),
        (F.col("kind") == RELEASE).alias("release"),
    )
    chunked = in_runs(narrow, ["key", "ts", "seq"], chunk_rows, "chunk")
    start = (
        events.sparkSession.createDataFrame([], "key string, initial bigint")
        if initial is None
        else initial.select(
            F.col("key").cast("string").alias("key"),
            F.unix_micros(F.col("held_until").cast("timestamp")).alias("initial"),
        )
    )
    entered = chunked.join(_entries(chunked, start, ttl), ["key", "chunk"])
    return entered.groupBy("key", "chunk").applyInPandas(_replay(ttl), "key string, seq bigint")


def request_dedup(
    requests: DataFrame, ttl_seconds: int = REQUEST_TTL_SECONDS, initial: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The requests to send: one per host and TTL, counted from the one that was sent.

    requests(host, ts, seq, ...), optionally `push_failed`: a push that failed gives its
    claim back at once, so it leaves no trace and is not among the sent ones.
    """
    usable = requests.filter(F.col("host").isNotNull())
    if "push_failed" in requests.columns:
        usable = usable.filter(~F.col("push_failed"))
    events = usable.select(F.col("host").alias("key"), "ts", "seq", F.lit(ACQUIRE).alias("kind"))
    sent = granted_claims(events, ttl_seconds, initial, chunk_rows).select("seq")
    return usable.join(sent, "seq", "left_semi")


def lease_key(stage: Column, domain: Column) -> Column:
    return F.concat_ws(":", stage, domain)


def lease_outcomes(
    events: DataFrame, ttl_seconds: int = LEASE_TTL_SECONDS, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """events(stage, domain, kind, ts, seq) with `granted` for the acquire attempts.

    A finished, requeued or failed task releases its lease; one that could learn nothing
    keeps it, which is an acquire without a release.
    """
    keyed = events.withColumn("key", lease_key(F.col("stage"), F.col("domain")))
    granted = granted_claims(keyed, ttl_seconds, None, chunk_rows).select("seq", F.lit(True).alias("granted"))
    return keyed.filter(F.col("kind") == ACQUIRE).join(granted, "seq", "left").withColumn(
        "granted", F.coalesce("granted", F.lit(False))
    ).drop("key")

