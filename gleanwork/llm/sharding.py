"""Shards in the order of a Hilbert curve over several metadata columns.

Each column is quantised into 2**bits levels of about equally many rows: a value's level is
the share of rows with a lesser value. The levels are the coordinates of a cell, and the
Hilbert curve numbers the cells so that neighbours on the curve differ by one level in one
column. Rows sorted by that number are cut into runs, the shards. A shard so covers a short
range of every column at once, and a filter on any of them skips most files by their least
and greatest values.

DataFrame operations only. Places in a global order come from a range sort: a row's place in
its partition, and the sums of the partitions before, one row each. The sort ends in a
number of the row, so no value, however frequent, has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.storage import kept

#: monotonically_increasing_id holds the partition above these bits.
PLACE_BITS = 33


def placed(rows: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """The rows with `rank`, how many rows (or how much weight) stand before each in the
    order. Rows equal in all of `order` stand in any order."""
    by = [F.asc_nulls_first(c) for c in order]
    ordered = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", PLACE_BITS).alias("part")
    each = F.lit(1) if weight is None else F.col(weight)
    # One row for each partition of the sort: the only window that is not parted.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy(part).agg(F.sum(each).alias("held"))
    offsets = sums.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    if weight is None:
        within = F.col("place").bitwiseAND((1 << PLACE_BITS) - 1)
    else:
        inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        within = F.coalesce(F.sum(weight).over(inside), F.lit(0))
    found = ordered.withColumn("part", part).join(F.broadcast(kept(offsets)), "part")
    return found.withColumn("rank", F.col("offset") + within).drop("part", "offset", "place")


def levels(rows: DataFrame, column: str, bits: int, total: int) -> DataFrame:
    """(value, level): each value's level, by the rows with lesser values; null is least."""
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return placed(counts, ["value"], "n").select("value", F.floor(F.col("rank") * (1 << bits) / total).cast("int").alias("level"))


def hilbert_index(cells: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """The cells with the place of each on the Hilbert curve; the axes are replaced.

    From the highest bit down, the part of the curve that a cell lies in is turned back into
    the position of the whole: where an axis has the bit, the first axis is inverted below
    it, else the two are swapped below it. What is left is a Gray code.
    """
    at = cells
    first, last = axes[0], axes[-1]
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in axes:
            up = F.col(axis).bitwiseAND(1 << bit) != 0
            swap = F.col(first).bitwiseXOR(F.col(axis)).bitwiseAND(below)
            turned = {first: F.when(up, F.col(first).bitwiseXOR(F.lit(below))).otherwise(F.col(first).bitwiseXOR(swap))}
            if axis != first:
                turned[axis] = F.when(up, F.col(axis)).otherwise(F.col(axis).bitwiseXOR(swap))
            at = at.withColumns(turned)
    for left, right in zip(axes, axes[1:], strict=False):
        at = at.withColumn(right, F.col(right).bitwiseXOR(F.col(left)))
    flips = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        flips = flips.bitwiseXOR(F.when(F.col(last).bitwiseAND(1 << bit) != 0, (1 << bit) - 1).otherwise(0))
    at = at.withColumn("_flips", flips)
    index = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for axis in axes:
            one = F.shiftright(F.col(axis).bitwiseXOR(F.col("_flips")), bit).bitwiseAND(1)
            index = F.shiftleft(index, 1).bitwiseOR(one.cast("long"))
    return at.withColumn(name, index).drop("_flips", *axes)


def assign(
    docs: DataFrame, dimensions: list[str], shards: int, law: str = "rows", bits: int = 5, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of `docs`: row, doc_id, size, text_crc32, curve, shard, slot.

    `size` is the text's bytes in UTF-8 (a null or empty text has none) and 16; `text_crc32`
    their checksum. Rows are ordered by their cell on the curve, in a cell by checksum, so
    that equal texts with equal metadata lie side by side, then by doc_id. `law` says what
    the cuts make equal: `rows`, the shards' counts, which differ by one at most, or `bytes`,
    their sizes, which differ by one row's size from the equal share. `slot` counts the rows
    of a shard from 0.

    Null metadata is a value of its own, the least; a null doc_id comes first of its ties;
    repeated rows are rows each, told apart by `row` (monotonically_increasing_id over the
    given frame). Fewer rows than shards leave shards empty; an empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    axes = [f"axis{i}" for i in range(len(dimensions))]
    facts = kept(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + 16).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            *[F.col(d).alias(a) for d, a in zip(dimensions, axes, strict=True)],
        )
    )
    totals = facts.agg(F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    cells = facts
    for axis in axes:
        found = kept(levels(facts, axis, bits, totals.rows)).withColumnsRenamed({"value": "held", "level": "found"})
        cells = cells.join(found, F.col(axis).eqNullSafe(F.col("held"))).withColumn(axis, F.col("found")).drop("held", "found")
    cells = hilbert_index(cells, axes, bits, "curve")
    order = ["curve", "text_crc32", "doc_id", "row"]
    ranked = placed(cells, order)
    if law == "rows":
        cut = ranked.withColumn("shard", F.expr(f"rank * {shards} div {totals.rows or 1}").cast("int"))
        return cut.withColumn("slot", F.col("rank") - F.expr(f"(shard * {totals.rows}L + {shards - 1}) div {shards}")).drop("rank")
    weighed = placed(ranked.withColumnRenamed("rank", "number"), order, "size")
    middle = F.expr(f"cast((2 * rank + size) * cast({shards} as decimal(20)) / (2 * {totals.bytes or 1}) as int)")
    cut = kept(weighed.withColumn("shard", F.least(middle, F.lit(shards - 1))))
    firsts = cut.groupBy("shard").agg(F.min("number").alias("first"))
    return cut.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("number") - F.col("first")).drop("rank", "number", "first")


def write_sharded(
    docs: DataFrame, path: str, dimensions: list[str], shards: int, law: str = "rows", bits: int = 5, doc_id: str = "doc_id", text: str = "text",
) -> None:
    """Write the documents as Parquet, a folder `_shard=N` for each shard, each in the order
    of its slots, with the columns they came with. A shard is written by one task, so their
    number should grow with the table. `docs` must number its rows alike each time it is
    read, as a table does; a column of the folders' name is refused."""
    if "_shard" in docs.columns:
        raise ValueError("a column has the name of the shards' folders")
    places = assign(docs, dimensions, shards, law, bits, doc_id, text).select("row", F.struct("shard", "slot").alias("at"))
    whole = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    joined = whole.join(places, "row").select("at", "doc")
    dealt = joined.repartition(shards, "at.shard").sortWithinPartitions("at.shard", "at.slot")
    dealt.select("doc.*", F.col("at.shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
