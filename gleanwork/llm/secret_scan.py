"""Secret scans by patterns and a battery of randomness tests, in DataFrame operations only.

Base: three patterns, leftmost matches without overlap for each kind. The method adds
strings that look drawn at random. Every run of 20 or more characters of key alphabets is a
candidate, and so is every part as long that is left when a run is cut at the separators an
encoding does not use: at _ and - for base64, at + and / for base64url, at all four for the
others. So a key behind a path or a prefix is tested by itself, too. A candidate's
encoding is inferred from the characters it uses, and under the hypothesis
"each character is an independent uniform draw from that encoding's alphabet" three tests
give p-values: chi-squared uniformity over the alphabet, the runs test about the alphabet's
middle, and lag-one serial correlation. The smallest, corrected for being one of three, is
the candidate's.

The hypotheses are rejected by the Benjamini-Hochberg rule, which controls the share of true
random strings among those thrown out. It runs within families of one encoding and one band
of lengths, as short strings give the tests little power and would drag down the threshold
of long ones. The rule needs only the number of p-values below each value: p-values are
counted in bins of a twentieth of a decade and a bin counts with its upper edge, so the
threshold is never too lax and nothing is sorted or collected. What is not rejected is
reported as kind `random`, unless it overlaps a base span or lies within another one reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.storage import kept, unused

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
KINDS = ("assign", "access", "hex", "random")
#: Shortest value of an assignment.
VALUE_LENGTH = 12

CANDIDATE = r"([A-Za-z0-9+/_-]{20,}+)"
#: What encodings leave of a run: base64, base64url, and those without any separator.
PARTS = (r"([A-Za-z0-9+/]{20,}+)", r"([A-Za-z0-9_-]{20,}+)", r"([A-Za-z0-9]{20,}+)")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings by name: the characters a string may use, its alphabet in order.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", DIGITS + "abcdef"),
    "HEX": ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", UPPER + "234567"),
    "base36": ("^[0-9a-z]+$", DIGITS + LOWER),
    "BASE36": ("^[0-9A-Z]+$", DIGITS + UPPER),
    "base62": ("^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    "base64": ("^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
}
#: What stands for a removed secret.
MARK = "[secret]"
#: Share of random strings among the rejected ones.
FALSE_DISCOVERIES = 0.01
#: Bins of p-values in a decade, and decades told apart.
BINS, DECADES = 20, 15


def hits(text: Column, pattern: str, kind: str) -> Column:
    """The matches of a pattern: the gap before each, its length, and what its last group holds.

    The pattern's first group is the whole match. Lengths are in code points.
    """
    # Behind the last match the rest is taken whole; else every start in it would be tried.
    led = rf"(?s)(.*?)(?:{pattern}|\z)"
    value = 3 if kind == "assign" else 2

    def group(i: int) -> Column:
        return F.regexp_extract_all(text, F.lit(led), F.lit(i))

    found = F.transform(
        F.arrays_zip(group(1).alias("gap"), group(2).alias("match"), group(value).alias("value")),
        lambda h: F.struct(
            F.lit(kind).alias("kind"),
            F.length(h["gap"]).cast("long").alias("gap"),
            F.length(h["match"]).cast("long").alias("width"),
            (F.length(h["value"]) >= (VALUE_LENGTH if kind == "assign" else 1)).alias("long_enough"),
            (h["match"] if kind == "random" else F.lit(None).cast("string")).alias("match"),
        ),
    )
    # Most texts hold no match, and a plain search is cheaper than taking matches apart.
    return F.when(F.rlike(text, F.lit(pattern)), found)


def spans_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per match of any kind: row, kind, start, end, match (of candidates)."""
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    patterns = zip((ASSIGN, ACCESS, HEX, CANDIDATE), KINDS, strict=True)
    kinds = F.filter(F.array(*[hits(F.col("text"), p, k) for p, k in patterns]), lambda a: a.isNotNull())
    # A position within its kind orders a text's matches: kinds are exploded one by one.
    each = texts.select("row", F.explode(kinds).alias("of_kind")).select("row", F.posexplode("of_kind").alias("at", "hit")).select("row", "at", "hit.*")
    before = Window.partitionBy("row", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.col("width")).over(before)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("width"))
    return placed.filter("long_enough").select("row", "kind", "start", "end", "match")


def with_parts(runs: DataFrame) -> DataFrame:
    """Runs (row, start, end, match) and the parts they are cut into, each once."""
    match = F.col("match")
    glued = runs.filter(F.rlike(match, F.lit("[+/_-]")))
    cuts = F.array(*[hits(match, p, "random") for p in PARTS])
    each = glued.select("row", F.col("start").alias("from"), F.posexplode(cuts).alias("cut", "of_cut")).filter("of_cut is not null")
    placed = each.select("row", "from", "cut", F.posexplode("of_cut").alias("at", "hit")).select("row", "from", "cut", "at", "hit.*")
    before = Window.partitionBy("row", "from", "cut").orderBy("at")
    ended = placed.withColumn("end", F.col("from") + F.sum(F.col("gap") + F.col("width")).over(before)).filter("long_enough")
    parts = ended.select("row", (F.col("end") - F.col("width")).alias("start"), "end", "match")
    return runs.select("row", "start", "end", "match").unionByName(parts).dropDuplicates(["row", "start", "end"])


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, to 7 digits (a rational approximation of erfc)."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.3275911 * x)
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def tested(candidates: DataFrame) -> DataFrame:
    """The candidates with an inferred encoding, its family and the battery's p-value.

    Strings without any letter or digit, or that mix + or / with _ or -, have no encoding.
    """
    match = F.col("match")
    written_in = F.rlike(match, F.lit("[0-9A-Za-z]"))
    encoding, alphabet = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (shape, letters) in reversed(ENCODINGS.items()):
        fits = F.rlike(match, F.lit(shape))
        encoding, alphabet = F.when(fits, F.lit(name)).otherwise(encoding), F.when(fits, F.lit(letters)).otherwise(alphabet)
    known = candidates.filter(written_in).withColumn("encoding", encoding).withColumn("alphabet", alphabet).filter("encoding is not null")
    n, k = F.length("match"), F.length("alphabet")
    codes = F.expr("transform(split(match, ''), c -> cast(instr(alphabet, c) - 1 as double))")
    halves = F.expr("translate(match, alphabet, concat(repeat('0', length(alphabet) div 2), repeat('1', length(alphabet) - length(alphabet) div 2)))")
    counted = known.select(
        "row", "start", "end", "encoding",
        n.cast("double").alias("n"), k.cast("double").alias("k"), codes.alias("codes"), halves.alias("halves"),
        F.expr("aggregate(split(alphabet, ''), 0D, (s, c) -> s + power(length(match) - length(replace(match, c, '')), 2))").alias("squares"),
    )
    sums = counted.select(
        "row", "start", "end", "encoding", "n", "k",
        (F.col("k") / F.col("n") * F.col("squares") - F.col("n")).alias("chi"),
        F.length(F.replace("halves", F.lit("0"), F.lit(""))).cast("double").alias("ones"),
        F.size(F.regexp_extract_all("halves", F.lit("0+|1+"), F.lit(0))).cast("double").alias("runs"),
        F.expr("aggregate(codes, 0D, (s, c) -> s + c)").alias("total"),
        F.expr("aggregate(codes, 0D, (s, c) -> s + c * c)").alias("total2"),
        F.expr("aggregate(zip_with(slice(codes, 1, size(codes) - 1), slice(codes, 2, size(codes) - 1), (a, b) -> a * b), 0D, (s, c) -> s + c)").alias("lagged"),
    )
    n, k, ones = F.col("n"), F.col("k"), F.col("ones")
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is nearly normal.
    spread = 2 / (9 * (k - 1))
    uniform = upper_tail((F.pow(F.col("chi") / (k - 1), F.lit(1 / 3)) - 1 + spread) / F.sqrt(spread))
    expected = 2 * ones * (n - ones) / n + 1
    variance = (expected - 1) * (expected - 2) / (n - 1)
    runs = F.when(variance > 0, 2 * upper_tail(F.abs(F.col("runs") - expected) / F.sqrt(variance))).otherwise(0.0)
    mean = F.col("total") / n
    power = F.col("total2") / n - mean * mean
    lag = F.when(power > 0, (F.col("lagged") / (n - 1) - mean * mean) / power)
    serial = F.when(lag.isNotNull(), 2 * upper_tail(F.abs(lag * n + 1) / F.sqrt(n))).otherwise(0.0)
    band = F.when(n < 32, "20").when(n < 64, "32").otherwise("64")
    return sums.select(
        "row", "start", "end",
        F.concat_ws("/", "encoding", band).alias("family"),
        F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial)).alias("p"),
    )


def not_rejected(candidates: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """The candidates (row, start, end, family, p) that stay under Benjamini-Hochberg."""
    slot = F.floor(-BINS * F.log10(F.greatest("p", F.lit(10.0**-DECADES)))).cast("int")
    binned = candidates.withColumn("bin", slot)
    counts = binned.groupBy("family", "bin").count()  # at most families x bins rows
    smaller = Window.partitionBy("family").orderBy(F.col("bin").desc())
    whole = Window.partitionBy("family")
    passed = F.pow(F.lit(10.0), -F.col("bin") / BINS) <= rate * F.sum("count").over(smaller) / F.sum("count").over(whole)
    edges = counts.withColumn("passed", passed).groupBy("family").agg(F.min(F.when(F.col("passed"), F.col("bin"))).alias("from"))
    judged = binned.join(F.broadcast(edges), "family")  # a row per family, of which there are a few
    return judged.filter(F.col("from").isNull() | (F.col("bin") < F.col("from")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: row, doc_id, spans, an array of (start, rank, end).

    `rank` is the kind's place in KINDS; starts and ends are code points, ends exclusive.
    `row` numbers the rows as monotonically_increasing_id does. Null and empty texts have no
    spans; repeated rows are scanned each; an empty table gives no rows.
    """
    found = kept(spans_of(docs, doc_id, text))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    base = found.filter("kind <> 'random'").select("row", "start", rank.alias("rank"), "end")
    loose = not_rejected(tested(with_parts(found.filter("kind = 'random'")))).select("row", "start", F.lit(3).alias("rank"), "end")
    at = Window.partitionBy("row").orderBy("start", "rank", F.desc("end"))
    is_base = F.col("rank") < 3
    reach = F.max(F.when(is_base, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(is_base, F.col("start"))).over(at.rowsBetween(0, Window.unboundedFollowing))
    both = base.unionByName(loose).withColumn("reach", reach).withColumn("following", following)
    clear = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("following") >= F.col("end"), F.lit(True))
    # Parts are reported within a run that is not, be it rejected or in the way of a base span.
    wider = F.max(F.when(~is_base, F.col("end"))).over(at.rowsBetween(Window.unboundedPreceding, -1))
    widest = both.filter(is_base | clear).withColumn("wider", wider).filter(is_base | F.col("wider").isNull() | (F.col("wider") < F.col("end")))
    spans = widest.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"))
    none = F.expr("cast(array() as array<struct<start: bigint, rank: int, end: bigint>>)")
    return rows.join(spans, "row", "left").withColumn("spans", F.coalesce("spans", none))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def without_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span's characters replaced by one mark, all columns kept.

    Overlapping spans are one stretch. Texts without spans, null ones among them, stay as
    they are; columns may have any names, and an empty table stays empty. `docs` must number
    its rows alike each time it is read, as a table does.
    """
    row, dirty_row, spans = unused(docs, "row", "dirty", "spans")
    dirty = scan(docs, doc_id, text).filter(F.size("spans") > 0).select(F.col("row").alias(dirty_row), F.col("spans").alias(spans))
    at = docs.withColumn(row, F.monotonically_increasing_id()).join(dirty, F.col(row) == F.col(dirty_row), "left")
    whole = F.col(text)
    masked = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] < acc["at"], acc["done"])
            .otherwise(F.concat(acc["done"], F.substring(whole, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MARK)))
            .alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))),
    )
    return at.withColumn(text, F.when(F.col(spans).isNull(), whole).otherwise(masked)).select(*docs.columns)

