"""Near-duplicate groups by HyperMinHash.

A document's set is its distinct word shingles, as 64-bit hashes. The hash space is parted
into buckets; a bucket's register holds, of the least hash in it, the leading-zero count and
the mantissa bits that follow: 16 bits instead of 64. Registers in bands of five are the
keys by which candidates meet. Before that an empty bucket borrows the register of another
one, chosen by a hash of both, so that small sets, too, need five equal registers to meet.

Candidates are judged by their registers first: equal ones, less those expected to be equal
by chance, estimate the Jaccard similarity. Only pairs six standard deviations below the
threshold or more are dropped; the rest is confirmed on the full sets. A pair right at a
threshold of 0.8 shares none of 64 bands with a probability of some 1e-6 and fails the
estimate with one of 1e-9.

Equal sets are one node. Bands do not emit all their pairs: each member meets its band's
least one, and links found make components. A band whose other members are still in
different components is open. Its members meet by prefixes: with every set's shingles
ordered by their frequency among open members, rarest first, two sets that are similar
enough share a shingle of the first ninth of the smaller and the first fifth of the larger
one (at a threshold of 0.8), and behind the first one shared, neither has too few left to
share, by its place in their orders and by bitmaps of both. Many documents around one passage,
similar but not enough, so make hardly a pair: what each holds for itself comes first, and the
passage behind it is too short. Links inside a component cannot change the result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.storage import kept, without_rows
from gleanwork.llm.words import TextWords, mixed, stretches

BANDS, ROWS = 64, 5
BUCKETS = BANDS * ROWS
#: Bits of a register's mantissa.
MANTISSA = 10
#: Standard deviations an estimate may fall short by.
DEVIATIONS = 6.0
#: Frequencies of shingles are counted in this many cells; they only order shingles.
CELLS = 1 << 20
#: 64-bit words of the bitmap by which two sets are held against each other.
WORDS = 16


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each row's distinct shingles, as sorted hashes; a shorter text is one shingle."""
    words = TextWords(texts, lower=True)
    runs, out = words.runs(width), []
    for begin, end in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if end - begin >= width:
            out.append(np.unique(runs[begin : end - width + 1]))
        elif end > begin:
            whole = np.uint64(end - begin)
            for h in words.hashes[0][begin:end]:
                whole = mixed(whole ^ h)
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The HyperMinHash registers of a sorted set; zero marks an empty bucket."""
    out = np.zeros(BUCKETS, "<u2")
    if not len(shingles):
        return out
    bucket = ((shingles >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    least = np.minimum.reduceat(mixed(shingles ^ np.uint64(0x5851F42D4C957F2D)), starts)
    zeros = 53 - np.frexp((least >> np.uint64(11)).astype(np.float64))[1]
    mantissa = (least >> (63 - MANTISSA - zeros).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[starts].astype(np.int64)] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


@functools.lru_cache(maxsize=1)
def _loans() -> np.ndarray:
    """For each bucket, how eagerly it borrows from each other one."""
    return mixed(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(1 << 40)).reshape(BUCKETS, BUCKETS)


def band_keys(row: np.ndarray) -> np.ndarray:
    """A key for each band of five registers, empty ones filled by loans."""
    held = np.flatnonzero(row)
    if len(held) < BUCKETS:
        empty = np.flatnonzero(row == 0)
        row = row.copy()
        row[empty] = row[held[_loans()[np.ix_(empty, held)].argmin(axis=1)]]
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in row.reshape(BANDS, ROWS).T.astype(np.uint64):
        key = mixed(key ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """The Jaccard similarity by two rows of registers, and the buckets it rests on."""
    used = int(((a != 0) | (b != 0)).sum())
    if not used:
        return 0.0, 0
    chance = 1 / (3 << MANTISSA)  # leading zeros agree for a third of unequal minima
    equal = int(((a == b) & (a != 0)).sum()) / used
    return (equal - chance) / (1 - chance), used


def fingerprints(docs: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """One row per row: row, doc_id, size of the set, two hashes of the set, registers."""
    schema = "row long, doc_id long, size long, sig1 long, sig2 long, registers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in stretches(batch.column(2)):
                part = batch.slice(begin, end - begin)
                sizes, sig1, sig2, rows = [], [], [], []
                for s in shingle_sets(part.column(2), width):
                    sizes.append(len(s))
                    sig1.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                    sig2.append(int((mixed(s ^ np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                    rows.append(registers(s).tobytes())
                columns = [part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in (sizes, sig1, sig2)), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "size", "sig1", "sig2", "registers"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema)


def banded(nodes: DataFrame) -> DataFrame:
    """(band, row, size) for each band of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, "<u2")) for r in batch.column(2).to_pylist()]
            if keys:
                repeated = [pa.array(np.repeat(batch.column(i).to_numpy(), BANDS)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *repeated], ["band", "row", "size"])

    return nodes.select("row", "size", "registers").mapInArrow(run, "band long, row long, size long")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (row, other) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            row, other = (batch.column(i).to_numpy() for i in (0, 1))
            left, right = ([np.frombuffer(r, "<u2") for r in batch.column(i).to_pylist()] for i in (2, 3))
            passed = []
            for at, (a, b) in enumerate(zip(left, right, strict=True)):
                near, used = estimate(a, b)
                if used and near >= percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / used) ** 0.5:
                    passed.append(at)
            linked = []
            some = batch.take(pa.array(passed, pa.int64()))
            for begin, end in stretches(some.column(4)):
                mine = shingle_sets(some.column(4).slice(begin, end - begin), width)
                for at, a in zip(range(begin, end), mine, strict=True):
                    # Rows come in the order of `other`, of which one set at a time is held.
                    key = int(other[passed[at]])
                    if key not in last:
                        last = {key: shingle_sets(some.column(5).slice(at, 1), width)[0]}
                    b = last[key]
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    if shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                        linked.append(passed[at])
            yield pa.RecordBatch.from_arrays([pa.array(row[linked]), pa.array(other[linked])], ["row", "other"])

    mine = texts.select("row", F.col("registers").alias("left"), F.col("text").alias("left_text"))
    theirs = texts.select(F.col("row").alias("other"), F.col("registers").alias("right"), F.col("text").alias("right_text"))
    both = pairs.join(mine, "row").join(theirs, "other")
    return both.select("row", "other", "left", "right", "left_text", "right_text").mapInArrow(run, "row long, other long")


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(row, component): the least row reachable over the links, from (row, component) so far.

    In each round a component joins the least one that a link of its members reaches, and
    then the one that this joins, so the rounds are few; they end when nothing changes.
    """
    both = links.select("row", "other").unionByName(links.select(F.col("other").alias("row"), F.col("row").alias("other")))
    edges = kept(both.distinct())
    while True:
        theirs = labels.select(F.col("row").alias("other"), F.col("component").alias("offer"))
        offers = edges.join(theirs, "other").groupBy("row").agg(F.min("offer").alias("offer"))
        best = labels.join(offers, "row", "left").select("component", F.least("component", "offer").alias("best"))
        moved = kept(best.groupBy("component").agg(F.min("best").alias("to")))
        if moved.filter("to < component").isEmpty():
            return labels
        onward = moved.select(F.col("component").alias("to"), F.col("to").alias("next"))
        jumped = moved.join(onward, "to").select("component", "next")
        labels = kept(labels.join(jumped, "component").select("row", F.col("next").alias("component")))


def cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(CELLS - 1)).astype(np.int64)


def frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """How many of the sets hold a shingle of each cell: a fixed number of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for begin, end in stretches(batch.column(0)):
                sets = shingle_sets(batch.column(0).slice(begin, end - begin), width)
                counts += np.bincount(cells(np.concatenate(sets)), minlength=CELLS)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(counts[cell])], ["cell", "n"])

    found = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A bit for every shingle's hash: one that another set's bitmap lacks is a shingle of
    this set alone."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(mixed(shingles) >> np.uint64(32)).astype(np.int64) % len(bits)] = 1
    return np.packbits(bits, bitorder="little").view("<i8")


def prefixes(texts: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(shingle, row, size, component, place, short, bits0...): the rarest shingles of each
    set with their place in its order, enough of them to meet every smaller similar set, and
    of these the ones that meet every larger one; with each the set's bitmap."""
    names = ["shingle", "row", "size", "component", "place", "short", *[f"bits{i}" for i in range(WORDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in stretches(batch.column(2)):
                part = batch.slice(begin, end - begin)
                sets = shingle_sets(part.column(2), width)
                sizes = np.array([len(s) for s in sets])
                # Of n shingles, all but as many as a similar set must share, and one more.
                longs, shorts = sizes - -(-percent * sizes // 100) + 1, sizes - -(-2 * percent * sizes // (100 + percent)) + 1
                firsts = [s[np.lexsort((s, counts[cells(s)]))[:long]] for s, long in zip(sets, longs.tolist(), strict=True)]
                held = np.array([len(f) for f in firsts])
                same = [pa.array(np.repeat(v, held)) for v in (part.column(0).to_numpy(), sizes, part.column(1).to_numpy())]
                place = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
                columns = [pa.array(np.concatenate(firsts).view(np.int64)), *same, pa.array(place), pa.array(place < np.repeat(shorts, held))]
                bits = np.repeat(np.array([bitmap(s) for s in sets]), held, axis=0)
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(np.ascontiguousarray(b)) for b in bits.T]], names)

    return texts.select("row", "component", "text").mapInArrow(run, "shingle long, row long, size long, component long, place long, short boolean, " + ", ".join(f"bits{i} long" for i in range(WORDS)))


def groups(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: row, doc_id, n_shingles, component_id, kept.

    Documents are linked if their sets of distinct `width`-word shingles (A-Z lower-cased,
    words parted by ASCII blanks) have a Jaccard similarity of `percent` or more; a component
    is what links reach, its id the least doc_id in it. A text of fewer words is one shingle.
    Null and blank texts have an empty set and link with nothing. In each component the row
    of the least doc_id is kept, the first of them if the id repeats; a null doc_id counts as
    the largest. `row` numbers rows as monotonically_increasing_id does. An empty table gives
    no rows; other columns are not read.
    """
    seen = kept(fingerprints(docs, width, doc_id, text))
    sets = ["size", "sig1", "sig2"]
    classes = kept(seen.filter("size > 0").groupBy(*sets).agg(F.min("row").alias("node")))
    nodes = seen.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select("row", "size", "registers")

    bands = banded(nodes)
    shared = kept(bands.groupBy("band").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    members = kept(bands.join(shared, "band"))
    nodes_in = members.select("row").distinct()
    involved = kept(nodes_in.withColumn("component", F.col("row")))
    bodies = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")).join(nodes_in, "row", "left_semi")
    texts = kept(bodies.join(seen.join(nodes_in, "row", "left_semi").select("row", "registers"), "row"))

    pairs = members.filter("row <> first").select("row", F.col("first").alias("other")).distinct()
    labels = components(involved, kept(confirmed(pairs, texts, width, percent)))

    # Every member has met its band's first one: open are bands where others differ.
    placed = members.filter("row <> first").join(labels, "row")
    open_bands = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_rows = kept(placed.join(open_bands.select("band"), "band", "left_semi").select("row", "component").distinct())
    open_texts = texts.select("row", "text").join(open_rows, "row")
    reach = kept(prefixes(open_texts, frequencies(open_texts, width), width, percent))
    smaller = reach.filter("short").drop("short")
    larger = reach.select("shingle", F.col("row").alias("other"), *[F.col(c).alias(f"other_{c}") for c in reach.columns if c not in ("shingle", "row", "short")])
    fits = (F.col("size") <= F.col("other_size")) & (100 * F.col("size") >= percent * F.col("other_size"))
    # Behind the first shingle that two sets share, they share no more than either has left,
    # and no shingle whose bit the other's bitmap lacks.
    alone, other_alone = F.lit(0), F.lit(0)
    for i in range(WORDS):
        mine, theirs = F.col(f"bits{i}"), F.col(f"other_bits{i}")
        alone += F.bit_count(mine.bitwiseAND(F.bitwise_not(theirs)))
        other_alone += F.bit_count(theirs.bitwiseAND(F.bitwise_not(mine)))
    left = F.least(F.col("size") - F.greatest("place", alone), F.col("other_size") - F.greatest("other_place", other_alone))
    enough = (100 + percent) * left >= percent * (F.col("size") + F.col("other_size"))
    met = smaller.join(larger, "shingle").filter((F.col("component") != F.col("other_component")) & fits & enough)
    ordered = met.select(F.greatest("row", "other").alias("row"), F.least("row", "other").alias("other")).distinct()
    return _named(seen, classes, components(labels, kept(confirmed(ordered, texts, width, percent))), sets)


def _named(seen: DataFrame, classes: DataFrame, labels: DataFrame, sets: list[str]) -> DataFrame:
    """Every row with its component, named by its least doc_id."""
    of_node = classes.join(labels.withColumnRenamed("row", "node"), "node", "left")
    placed = kept(of_node.select(*sets, F.coalesce("component", "node").alias("component")))
    alone = seen.filter("size = 0").select("row", "doc_id", "size", F.col("row").alias("component"))
    rows = kept(seen.select("row", "doc_id", *sets).join(placed, sets).select("row", "doc_id", "size", "component").unionByName(alone))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    firsts = kept(rows.groupBy("component").agg(F.min(order).alias("first")))
    return rows.join(firsts, "component").select(
        "row",
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("row") == F.col("first.row")).alias("kept"),
    )


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all their columns, whatever their names. An empty table stays
    empty. `docs` must number its rows alike each time it is read, as a table does."""
    return without_rows(docs, groups(docs, width, percent, doc_id, text).filter(~F.col("kept")).select("row"))
