"""Exact top-k search by inner product over a bit-sliced index.

Rows are dealt to blocks; in a block every attribute is stored as bitmaps, one for each bit
of its value above the block's least value of that attribute. A query's scores are never
computed row by row: for each set bit of a query's component the attribute's slices join the
columns of their weight, and the columns are added by bitwise full adders, three bitmaps of
a weight becoming one of it and one of the next. The sums' slices, read from the most
significant one down, split the rows into certain, possible and excluded ones until k are
left; rows equal in every slice are the boundary, resolved by their smaller ids. A negative
component takes the complements of the slices, with the constant that they add taken off.

The slices are made once, when the index is built, and stored by block; the values are not
kept. A row's exact score is read off the slices of the sums. Rows are dealt to blocks by
their number, so repeated ids spread like any others. Queries meet every block in chunks,
and each block gives its k best, of which the best are the answer.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.storage import kept

#: Mean number of rows of a block, and of queries that visit it together.
BLOCK_ROWS, CHUNK = 32_768, 1024
INDEX = "dim int, block int, ids binary, least binary, bits binary, slices binary"
FOUND = "query long, query_id long, vec_id long, score long"


def quantised(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component; null if a component is null or not finite."""
    whole = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return F.when(whole, F.transform(vector, lambda x: F.floor(factor * x.cast("double")).cast("long")))


class SlicedBlock:
    """The bit slices of a block of integer vectors, ordered by their ids."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, bits: np.ndarray, slices: np.ndarray):
        """`slices` holds the bitmaps of all attributes, `bits` of each, a row a bitmap."""
        self.ids, self.least, self.bits = ids, least, bits
        self.rows = len(ids)
        ends = np.cumsum(bits)
        self.slices = [slices[e - n : e] for e, n in zip(ends.tolist(), bits.tolist(), strict=True)]
        self.all = self.bitmap(np.ones(self.rows, np.uint8))

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        least = values.min(axis=0) if len(ids) else np.zeros(values.shape[1], np.int64)
        above = (values[order] - least).T
        bits = np.array([int(a.max()).bit_length() if len(ids) else 0 for a in above], np.int64)
        width = len(cls.bitmap(np.ones(len(ids), np.uint8)))
        slices = [cls.bitmap((a >> b) & 1) for a, n in zip(above, bits.tolist(), strict=True) for b in range(n)]
        return cls(ids[order], least, bits, np.array(slices, "<u8").reshape(len(slices), width))

    def stored(self) -> tuple[bytes, ...]:
        """ids, least values, bits and slices as bytes."""
        return tuple(np.ascontiguousarray(a).tobytes() for a in (self.ids, self.least, self.bits, np.concatenate([np.zeros((0, len(self.all)), "<u8"), *self.slices])))

    @classmethod
    def read(cls, ids: bytes, least: bytes, bits: bytes, slices: bytes) -> SlicedBlock:
        known = np.frombuffer(ids, "<i8")
        count = np.frombuffer(bits, "<i8")
        width = -(-len(known) // 64)
        return cls(known, np.frombuffer(least, "<i8"), count, np.frombuffer(slices, "<u8").reshape(int(count.sum()), width))

    @staticmethod
    def bitmap(bits: np.ndarray) -> np.ndarray:
        """Bits packed into 64-bit words, zeros behind the last row."""
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.pad(packed, (0, -len(packed) % 8)).view("<u8")

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices of every row's score, less a constant, from the least weight up."""
        columns: dict[int, list[np.ndarray]] = defaultdict(list)
        for at in np.flatnonzero(query).tolist():
            component = int(query[at])
            slices = self.slices[at] if component > 0 else ~self.slices[at]
            component = abs(component)
            shift = 0
            while component:
                if component & 1:
                    for b, bitmap in enumerate(slices):
                        columns[shift + b].append(bitmap)
                component >>= 1
                shift += 1
        out = []
        weight = 0
        while columns:
            held, carries = columns.pop(weight, []), []
            while len(held) > 2:
                a, b, c = held.pop(), held.pop(), held.pop()
                either = a ^ b
                held.append(either ^ c)
                carries.append((a & b) | (either & c))
            if len(held) == 2:
                carries.append(held[0] & held[1])
                held = [held[0] ^ held[1]]
            out.append(held[0] if held else np.zeros_like(self.all))
            if carries:
                columns[weight + 1].extend(carries)
            weight += 1
        return out

    def best(self, query: np.ndarray, own: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and exact scores of the k best rows but those of the id `own`."""
        possible = self.all.copy()
        if own is not None:
            for row in range(*np.searchsorted(self.ids, [own, own + 1]).tolist()):
                possible[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        certain = np.zeros_like(possible)
        sums = self.sums(query)
        for slice_ in reversed(sums):
            wide = certain | (possible & slice_)
            count = int(np.bitwise_count(wide).sum())
            if count > k:
                possible &= slice_
            else:
                certain = wide
                possible &= ~slice_
                if count == k:
                    break
        sure = np.flatnonzero(np.unpackbits(certain.view(np.uint8), bitorder="little"))
        ties = np.flatnonzero(np.unpackbits(possible.view(np.uint8), bitorder="little"))
        rows = np.concatenate([sure, ties[: max(0, k - len(sure))]])
        scores = np.full(len(rows), self.constant(query), np.int64)
        for weight, slice_ in enumerate(sums):
            scores += ((slice_[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << weight
        return self.ids[rows], scores

    def constant(self, query: np.ndarray) -> int:
        """What the least values and the complements add to every row's score."""
        complements = np.where(query < 0, -query * ((1 << self.bits) - 1), 0)
        return int((query * self.least - complements).sum())


def search(vectors: DataFrame, is_query: Column, k: int = 20, factor: int = 64, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, chunk: int = CHUNK) -> DataFrame:
    """Each query's k best rows: query_id, rank, vec_id, score; ties go to smaller ids.

    Queries are the rows `is_query` holds for; candidates are all rows but those of the
    query's own id. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; vectors of another length than the query's are no
    candidates. Repeated rows are candidates each, and queries each. Fewer than k candidates
    give fewer rows, an empty table none. Scores are exact while they fit 64 bits.
    """
    whole = vectors.select(F.col(vec_id).cast("long").alias("id"), quantised(F.col(vector), factor).alias("vector"), is_query.alias("asks"))
    rows = whole.filter("id is not null and vector is not null").withColumn("dim", F.size("vector"))
    blocks = -(-vectors.count() // block_rows) or 1
    chunks = -(-rows.filter("asks").count() // chunk) or 1

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.array(frame["vector"].tolist(), "<i8").reshape(len(frame), -1)
        first = frame.iloc[0]
        block = SlicedBlock.of(frame["id"].to_numpy("<i8"), values)
        return pd.DataFrame([(first["dim"], first["block"], *block.stored())], columns=["dim", "block", "ids", "least", "bits", "slices"])

    # Which block a row is in changes no result, so its number need not be the same twice.
    number = F.xxhash64(F.monotonically_increasing_id())
    dealt = rows.select("dim", F.pmod(number, F.lit(blocks)).cast("int").alias("block"), "id", "vector")
    index = kept(dealt.groupBy("dim", "block").applyInPandas(packed, INDEX))
    asking = rows.filter("asks").select(F.monotonically_increasing_id().alias("query"), "dim", "id", "vector")
    asking = asking.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(chunks)).cast("int"))
    visits = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hosts = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def answered(host: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(host) and len(visitors):
            one = host.iloc[0]
            block = SlicedBlock.read(one["ids"], one["least"], one["bits"], one["slices"])
            for query, own, values in zip(visitors["query"], visitors["id"], visitors["vector"], strict=True):
                found, scores = block.best(np.array(values, np.int64), int(own), k)
                out.append(pd.DataFrame({"query": query, "query_id": own, "vec_id": found, "score": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")

    keys = ("dim", "block", "chunk")
    found = hosts.groupBy(*keys).cogroup(visits.groupBy(*keys)).applyInPandas(answered, FOUND)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
