"""The registered queries of this package over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwork.llm import (
    bpe_tree,
    exact_dedup,
    lexical,
    license_scan,
    near_dedup,
    packing,
    secret_scan,
    sharding,
    spelling,
    substring_dedup,
    token_counts,
    top_k,
    toxicity,
)
from gleanwork.llm.storage import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Python workers get bounded batches: a text may be megabytes long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def bounded(spark: SparkSession) -> SparkSession:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(bounded(spark), sf_dir)

    run.__name__ = build.__name__
    QUERIES[build.__name__] = run
    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe_tree.round_trip(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.with_counts(documents(spark, sf_dir), path, 512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
    WITH texts AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
    ), windows AS (
        SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS content
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS p FROM texts WHERE len(words) >= 20)
    ), repeats AS (
        SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY content ORDER BY doc_id, p) AS n FROM windows) WHERE n > 1
    ), removed AS (
        SELECT DISTINCT doc_id, p + i AS place FROM repeats, range(20) AS r(i)
    ), placed AS (
        SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
    ), kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM placed ANTI JOIN removed USING (doc_id, place) GROUP BY doc_id
    )
    SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM texts LEFT JOIN kept USING (doc_id)
"""


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copies(documents(spark, sf_dir)).drop("row")


ORACLES["op4_exact_dedup"] = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir))
    best = F.get("licenses", F.lit(0))
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        best["license"].alias("license"),
        best["kind"].alias("kind"),
        best["coverage"].alias("coverage"),
        best["start"].cast("long").alias("first_word"),
        best["stop"].cast("long").alias("past_word"),
        F.array_join(F.transform("licenses", lambda f: f["license"]), ",").alias("licenses"),
    )


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(documents(spark, sf_dir), width=2).drop("row")


ORACLES["op6_near_dedup"] = r"""
    WITH RECURSIVE texts AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
        FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) END AS shingles
        FROM texts
    ), each AS (
        SELECT doc_id, len(shingles) AS size, unnest(shingles) AS shingle FROM sets
    ), links AS (
        SELECT a.doc_id AS one, b.doc_id AS other
        FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.size, b.size
        HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))
    ), reached AS (
        SELECT doc_id, doc_id AS other FROM sets
        UNION
        SELECT reached.doc_id, links.other FROM reached JOIN links ON links.one = reached.other
    ), named AS (
        SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
    )
    SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN named USING (doc_id)
"""


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k.search(vectors, F.col("vec_id") % 20 == 0)


ORACLES["op7_top_k"] = """
    WITH whole AS (
        SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
               CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
    WHERE rank <= 20
"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.with_scores(documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


@query
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["rank"] < 3)

    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def checksum_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in SQL, over the byte table `crc_table` of `CRC_TABLE`."""
    octets = f"[('0x' || h)::BIGINT for h in regexp_extract_all(hex(encode({text})), '..')]"
    step = "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({octets}, {step}, 4294967295::BIGINT), 4294967295)"


def _checksum_table() -> str:
    values = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        values.append(byte)
    return f"(SELECT {values}::BIGINT[] AS crc_table)"


CRC_TABLE = _checksum_table()
DIMENSIONS, SHARDS, BITS = ["lang", "source", "n_chars"], 40, 5


@query
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir), DIMENSIONS, SHARDS, "rows", BITS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def _hilbert_sql(cells: str, axes: list[str], bits: int) -> str:
    """A query that adds `curve` to the rows of `cells`, one nested step for each turn."""
    first, last, sql = axes[0], axes[-1], f"SELECT * FROM {cells}"
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for axis in axes:
            swap = f"xor({first}, {axis}) & {below}"
            turned = [f"CASE WHEN {axis} & {1 << bit} <> 0 THEN xor({first}, {below}) ELSE xor({first}, {swap}) END AS {first}"]
            if axis != first:
                turned.append(f"CASE WHEN {axis} & {1 << bit} <> 0 THEN {axis} ELSE xor({axis}, {swap}) END AS {axis}")
            sql = f"SELECT * REPLACE ({', '.join(turned)}) FROM ({sql})"
    for left, right in zip(axes, axes[1:], strict=False):
        sql = f"SELECT * REPLACE (xor({right}, {left}) AS {right}) FROM ({sql})"
    flips = "0"
    for bit in range(bits - 1, 0, -1):
        flips = f"xor({flips}, CASE WHEN {last} & {1 << bit} <> 0 THEN {(1 << bit) - 1} ELSE 0 END)"
    digits = [f"((xor({axis}, flips) >> {bit}) & 1)" for bit in range(bits - 1, -1, -1) for axis in axes]
    index = " + ".join(f"{d} * {1 << len(digits) - 1 - i}" for i, d in enumerate(digits))
    return f"SELECT *, {index} AS curve FROM (SELECT *, {flips} AS flips FROM ({sql}))"


def _levels_sql(column: str) -> str:
    before = "coalesce(sum(n) OVER (ORDER BY value NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    counts = f"SELECT {column} AS value, count(*) AS n FROM documents GROUP BY {column}"
    return f"SELECT value, CAST(floor({before} * {1 << BITS} / (SELECT count(*) FROM documents)) AS BIGINT) AS level FROM ({counts})"


ORACLES["op13_sharding"] = f"""
    WITH cells AS (
        SELECT doc_id, text, {", ".join(f"{d}_levels.level AS {d}" for d in DIMENSIONS)}
        FROM documents {" ".join(f"JOIN ({_levels_sql(d)}) AS {d}_levels ON documents.{d} IS NOT DISTINCT FROM {d}_levels.value" for d in DIMENSIONS)}
    ), facts AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, {checksum_sql("coalesce(text, '')")} AS text_crc32, curve
        FROM ({_hilbert_sql("cells", DIMENSIONS, BITS)}), {CRC_TABLE}
    ), ranked AS (
        SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST) - 1 AS rank, (SELECT count(*) FROM documents) AS n FROM facts
    )
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(rank * {SHARDS} // n AS INTEGER) AS shard,
           rank - (rank * {SHARDS} // n * n + {SHARDS - 1}) // {SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, curve
    FROM ranked
"""


def _misheard(ident: Column, word: Column) -> Column:
    """The word without one letter, where the checksum of the document's id and the word says."""
    h = F.crc32(F.concat(ident, F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))).otherwise(word)


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = kept(spelling.counted(documents(spark, sf_dir), 6, 5, heard=_misheard))
    return spelling.variants(words, ratio=5)


_LATIN = "".join(map(chr, range(0xC0, 0x100)))
#: As many one-byte characters, none a small letter: the SQL function counts edits of bytes.
_BYTES = "".join(chr(c) for c in range(0x21, 0x7F) if not 0x61 <= c <= 0x7A and c != 0x27)[: len(_LATIN)]

ORACLES["op12_spelling_variants"] = f"""
    WITH RECURSIVE runs AS (
        SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
    ), low AS (
        SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS word, count(*) AS n FROM runs GROUP BY ALL
    ), heard AS (
        SELECT word, n, {checksum_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word")} AS h FROM low, {CRC_TABLE}
    ), said AS (
        SELECT CASE WHEN h % 199 = 0 THEN word[:h % length(word)] || word[h % length(word) + 2:] ELSE word END AS word, n FROM heard
    ), vocabulary AS (
        SELECT word, CAST(sum(n) AS BIGINT) AS n FROM said WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
    ), coded AS (
        SELECT word, n, length(word) AS size, translate(word, '{_LATIN}', '{_BYTES}') AS code FROM vocabulary
    ), near AS (
        SELECT a.word, a.n, b.word AS other, b.n AS other_n
        FROM coded a JOIN coded b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word AND levenshtein(a.code, b.code) = 1
    ), best AS (
        SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word, n
    ), forms AS (
        SELECT word, other AS form, other_n AS form_n FROM best WHERE other_n >= 5 * n
    ), steps AS (
        SELECT word, word AS root FROM vocabulary
        UNION ALL
        SELECT steps.word, forms.form FROM steps JOIN forms ON steps.root = forms.word
    ), roots AS (
        SELECT word, root FROM steps WHERE root NOT IN (SELECT word FROM forms)
    )
    SELECT word, form, root, vocabulary.n, coalesce(n_near, 0) AS n_near, form_n
    FROM vocabulary JOIN roots USING (word) LEFT JOIN (SELECT word, n_near FROM best) USING (word) LEFT JOIN forms USING (word)
"""


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 50)


def _terms_sql(table: str, key: str) -> str:
    low = f"translate(coalesce(text, ''), '{lexical.UPPER}', '{lexical.LOWER}')"
    return f"SELECT {key}, unnest(regexp_extract_all({low}, '{lexical.TERMS}')) AS term FROM {table}"


ORACLES["op11_lexical_search"] = f"""
    WITH tfs AS (
        SELECT doc_id, term, count(*) AS tf FROM ({_terms_sql("documents", "doc_id")}) GROUP BY doc_id, term
    ), lengths AS (
        SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id
    ), totals AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
    ), weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, totals GROUP BY term, docs
    ), asked AS (
        SELECT DISTINCT item_id, term FROM ({_terms_sql("benchmark", "item_id")})
    ), scored AS (
        SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
        FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
        GROUP BY item_id, doc_id
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 50
"""
