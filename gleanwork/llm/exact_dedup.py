"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text's bytes are cut into blocks of a fixed size. The blocks that occur more than once in
the corpus are sorted (by a prefix, then a hash, then themselves) and take their place in that
order as an integer name. Then adjacent
names are paired and the pairs named the same way, level by level, until a document has one
name left. Two texts of equally many blocks have equal names if and only if they are equal:
names stand for contents, no hash is involved.

A block or pair that occurs once needs no name. It proves its document unique, so the
document leaves, and each level works on what may still have a copy.

Counting occurrences combines per task before the shuffle. A name is fetched by a join whose
sides are plain shuffles, which adaptive execution splits where a block is very frequent;
no group of copies ever meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.storage import kept, without_rows

#: Bytes of a block, and of the prefix by which blocks are parted for sorting.
BLOCK, PREFIX = 4096, 48


def blocks_of(body: Column, size: int) -> Column:
    """The blocks of a binary; an empty one is one empty block."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / size)).cast("int")
    # The inner lambda's variable holds the bytes, so they are read once, not for each block.
    cut = F.transform(
        F.array(body),
        lambda whole: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(whole, i * size + 1, F.lit(size))),
    )
    return F.element_at(cut, 1)


def named(parts: DataFrame, keys: list[str]) -> DataFrame:
    """The parts (row, doc_id, sha, size, at, keys...) as one row per document with its names.

    `names` is null for documents with a part that occurs once.
    """
    repeated = parts.groupBy(*keys).count().filter("count > 1").select(*keys)
    # Sorted in ranges of a prefix, whose bounds alone pass through the driver. Blocks that
    # share one are parted by a hash, which decides their order and nothing else.
    parts_count = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.substring(keys[0], 1, PREFIX), F.xxhash64(*keys)] if len(keys) == 1 else [F.col(k) for k in keys]
    ranged = repeated.repartitionByRange(parts_count, *order).sortWithinPartitions(*order, *keys)
    names = kept(ranged.withColumn("name", F.monotonically_increasing_id()))
    found = parts.join(names, keys, "left")
    whole = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("sha").alias("sha"),
        F.max("size").alias("size"),
        F.count_if(F.col("name").isNull()).alias("alone"),
        F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("at", "name")))).alias("names"),
    )
    names_only = F.when(F.col("alone") == 0, F.transform("names", lambda n: n["name"]))
    return kept(whole.select("row", "doc_id", "sha", "size", names_only.alias("names")))


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, text_sha256.

    `keep_id` is the largest doc_id among equal texts; the one row with it is kept. `row` is
    the row's number in the given frame (monotonically_increasing_id over it), which stands
    for the row where ids repeat: of repeated rows, the last one counts as the larger. Null
    texts count as empty, and empty texts are equal. A null doc_id counts as the smallest.
    An empty table gives no rows; other columns are not read.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), body.alias("body"))
    cut = texts.select(
        "row",
        "doc_id",
        F.unhex(F.sha2("body", 256)).alias("sha"),
        F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block)).cast("int").alias("size"),
        F.posexplode(blocks_of(F.col("body"), block)).alias("at", "part"),
    )
    level = named(cut.withColumn("sha", F.when(F.col("at") == 0, F.col("sha"))), ["part"])
    unique, grouped = [], []
    while True:
        unique.append(level.filter(F.col("names").isNull()))
        grouped.append(level.filter(F.size("names") == 1).withColumn("name", F.col("names")[0]))
        level = level.filter(F.size("names") > 1)
        if level.isEmpty():
            break
        pairs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.get("names", i * 2).alias("left"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("right")),
        )
        at = level.select("row", "doc_id", "sha", "size", F.posexplode(pairs).alias("at", "pair"))
        level = named(at.select("row", "doc_id", "sha", "size", "at", "pair.*"), ["left", "right"])
    return _decided(_union(unique), _union(grouped))


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def _decided(unique: DataFrame, grouped: DataFrame) -> DataFrame:
    """Which row of each group stays. A name counts among texts of equally many blocks."""
    last = F.max(F.struct("doc_id", "row")).alias("last")
    groups = kept(grouped.groupBy("size", "name").agg(last, F.count("*").alias("group_size")))
    members = grouped.join(groups, ["size", "name"]).select(
        "row", "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col("last.row") == F.col("row")).alias("kept"), "sha"
    )
    alone = unique.select(
        "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha"
    )
    return alone.unionByName(members).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever their names. An empty table stays
    empty. `docs` must number its rows alike each time it is read, as a table does."""
    return without_rows(docs, copies(docs, doc_id, text).filter(~F.col("kept")).select("row"))
