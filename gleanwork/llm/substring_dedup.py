"""Substring deduplication over word windows, found by difference-cover anchors.

Positions whose remainder by a period lies in a difference cover are anchors: for any two
positions there is a shift below the period after which both are anchors. Two equal windows
of `length` words therefore share, at the same place inside them, a run of
`length - period + 1` words that starts at an anchor of both texts. So only runs at anchors
(4 of 13 positions) are hashed and compared over the corpus, and only windows around a run
that occurs elsewhere are extended to the full window and compared. Comparing gives each
distinct window the smallest document it starts in; every other occurrence is a repeat.

Texts are handled in chunks of some megabytes, made alike each time the table is read. A
chunk sends each distinct hash once, as arrays for each range of hashes, so a passage in a
third of all documents is one entry per chunk; after the shuffle the arrays are exploded and
compared by a window function inside their partition. What comes back to a chunk is the
places of its entries that occur elsewhere (or earlier).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.words import TextWords

#: A difference cover and its period: each remainder is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Bytes of text in a chunk.
CHUNK = 4 << 20


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Numbered chunks of (doc_id, text) rows; a longer text is a chunk of its own."""
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        begin = 0
        for at, bytes_ in enumerate(sizes):
            if size and size + bytes_ > CHUNK:
                held.append(batch.slice(begin, at - begin))
                yield number, pa.Table.from_batches(held)
                number, held, size, begin = number + 1, [], 0, at
            size += bytes_
        held.append(batch.slice(begin))
    if held and sum(b.num_rows for b in held):
        yield number, pa.Table.from_batches(held)


def grouped(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard with the places of its entries, in order."""
    order = np.argsort(shards, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(shards[order]) != 0])) if len(order) else []
    for begin, end in zip(starts, [*starts[1:], len(order)], strict=True):
        yield int(shards[order[begin]]), order[begin:end]


class ChunkWords:
    """A chunk's words, its anchors, and the windows that its anchors leave open."""

    def __init__(self, table: pa.Table, length: int, shards: int):
        self.length, self.shards = length, shards
        self.doc_ids = pc.fill_null(table.column(0), np.iinfo(np.int64).max).to_numpy()
        self.texts = table.column(1).combine_chunks()
        self.words = TextWords(self.texts, seeds=(1, 2))
        bounds = self.words.bounds
        counts = np.diff(bounds)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.row)) - bounds[:-1][self.row]
        self.left = bounds[1:][self.row] - np.arange(len(self.row))
        self.run = length - PERIOD + 1
        self.anchors = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= self.run))
        hashes = self.words.runs(self.run)[self.anchors] if len(self.anchors) else np.zeros(0, np.uint64)
        self.distinct, self.which, self.times = np.unique(hashes, return_inverse=True, return_counts=True)

    def shard(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(40)).astype(np.int64) % self.shards

    def open_windows(self, replies: dict[int, np.ndarray]) -> None:
        """Find the distinct windows around repeated anchors, by the anchors' replies."""
        repeated = self.times > 1
        for shard, places in grouped(self.shard(self.distinct)):
            if shard in replies:
                repeated[places[replies[shard]]] = True
        total = len(self.row)
        seen = np.zeros(total + PERIOD + 1, np.int64)
        seen[self.anchors[repeated[self.which]] + 1] = 1
        seen = np.cumsum(seen)
        at = np.flatnonzero(self.left >= self.length)
        at = at[seen[at + PERIOD] > seen[at]]
        # In the order of doc_id, rows, places: the first of equal windows is the earliest.
        self.windows = at[np.lexsort((at, self.doc_ids[self.row[at]]))]
        first, second = (self.words.runs(self.length, k)[self.windows] if len(at) else np.zeros(0, np.uint64) for k in (0, 1))
        _, index, which = np.unique(first, return_index=True, return_inverse=True)
        order = np.argsort(index)
        self.earliest = index[order]
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.window = rank[which]
        self.keys, self.checks = first[self.earliest], second[self.earliest]
        self.owner = self.doc_ids[self.row[self.windows[self.earliest]]]

    def repeats(self, replies: dict[int, np.ndarray]) -> np.ndarray:
        """Whether each word is covered by a window that starts earlier, too."""
        later = np.zeros(len(self.keys), bool)
        for shard, places in grouped(self.shard(self.keys)):
            if shard in replies:
                later[places[replies[shard]]] = True
        rows = self.row[self.windows]
        owns = self.doc_ids[rows] == self.owner[self.window]
        fresh = np.zeros(len(self.windows), bool)
        fresh[np.unique(rows * np.int64(len(self.keys) + 1) + self.window, return_index=True)[1]] = True
        starts = self.windows[later[self.window] | ~owns | ~fresh]
        cover = np.zeros(len(self.row) + self.length + 1, np.int64)
        cover[starts] += 1
        cover[starts + self.length] -= 1
        return np.cumsum(cover)[: len(self.row)] > 0


def _replies(shards: list | None, places: list | None) -> dict[int, np.ndarray]:
    return {s: np.array(p, np.int64) for s, p in zip(shards or [], places or [], strict=True)}


def _compared(entries: DataFrame, columns: list[str], key: list[str], flag) -> DataFrame:
    """For each chunk, by shard, the places of its entries that `flag` holds for.

    `entries` has chunk, shard and equally long arrays. Equal keys are in one shard, so the
    comparison needs no further shuffle.
    """
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = entries.repartition(parts, "shard")
    each = dealt.select("chunk", "shard", F.posexplode(F.arrays_zip(*columns)).alias("place", "entry")).select("chunk", "shard", "place", "entry.*")
    marked = each.withColumn("marked", flag(Window.partitionBy("shard", *key))).filter("marked")
    by_shard = marked.groupBy("shard", "chunk").agg(F.collect_list("place").alias("places"))
    return by_shard.groupBy("chunk").agg(F.collect_list("shard").alias("shards"), F.collect_list("places").alias("places"))


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(body)).read_all()


def repeats(docs: DataFrame, length: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_text.

    Words are runs of anything but ASCII blanks. A word is removed if a window of `length`
    words of its text that covers it also starts in a text of a smaller doc_id, or earlier in
    its own; windows are judged on the input. `kept_text` is the kept words joined by one
    space, in UTF-8. Null texts have no words, texts shorter than a window lose none. A null
    doc_id counts as the largest. Rows that share a doc_id are no copies of one another;
    each is judged against smaller ids and itself. An empty table gives no rows; other
    columns are not read. `docs` must give its rows alike each time it is read, as a table
    does.
    """
    if length < PERIOD:
        raise ValueError(f"windows need {PERIOD} words at least")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = "chunk long, shard int, hashes array<long>"

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunks(batches):
            words = ChunkWords(table, length, shards)
            found = [(shard, words.distinct[places].view(np.int64)) for shard, places in grouped(words.shard(words.distinct))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int32()), pa.array([h for _, h in found], pa.list_(pa.int64()))],
                ["chunk", "shard", "hashes"],
            )

    anchors = _compared(rows.mapInArrow(anchored, signed), ["hashes"], ["hashes"], lambda w: F.count("*").over(w) > 1)

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, table in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([_packed(table)], pa.binary())], ["chunk", "body"])

    texts = rows.mapInArrow(bodies, "chunk long, body binary")
    told = texts.join(anchors, "chunk", "left").select("chunk", "body", "shards", "places")

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                chunk, body, of, places = (batch.column(i)[one].as_py() for i in range(4))
                words = ChunkWords(_unpacked(body), length, shards)
                words.open_windows(_replies(of, places))
                found = list(grouped(words.shard(words.keys)))
                arrays = [
                    pa.array([values[p] for _, p in found], pa.list_(kind))
                    for values, kind in ((words.keys.view(np.int64), pa.int64()), (words.checks.astype(np.uint32).view(np.int32), pa.int32()), (words.owner, pa.int64()))
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(found), pa.int64()), pa.array([s for s, _ in found], pa.int32()), *arrays],
                    ["chunk", "shard", "hashes", "checks", "owners"],
                )

    windows = told.mapInArrow(extended, signed + ", checks array<int>, owners array<long>")
    later = _compared(windows, ["hashes", "checks", "owners"], ["hashes", "checks"], lambda w: F.col("owners") > F.min("owners").over(w))
    judged = told.join(later.select("chunk", F.col("shards").alias("later_shards"), F.col("places").alias("later")), "chunk", "left")

    def kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in range(batch.num_rows):
                _, body, of, places, later_of, later_places = (batch.column(i)[one].as_py() for i in range(6))
                table = _unpacked(body)
                words = ChunkWords(table, length, shards)
                words.open_windows(_replies(of, places))
                stays = ~words.repeats(_replies(later_of, later_places))
                bounds = words.words.bounds.tolist()
                texts = [b"" if t is None else t.encode() for t in table.column(1).to_pylist()]
                kept = [b" ".join(compress(t.split(), stays[a:b].tolist())) for t, a, b in zip(texts, bounds, bounds[1:], strict=False)]
                sums = np.concatenate([[0], np.cumsum(stays)])
                counts = np.diff(words.words.bounds)
                removed = counts - np.diff(sums[words.words.bounds])
                yield pa.RecordBatch.from_arrays(
                    [table.column(0).combine_chunks(), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_words", "n_removed", "kept_text"],
                )

    return judged.mapInArrow(kept_words, "doc_id long, n_words long, n_removed long, kept_text binary")
