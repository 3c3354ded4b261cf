import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from gleanwork.llm import exact_dedup, near_dedup, substring_dedup
from gleanwork.llm.queries import ORACLES, QUERIES
from gleanwork.llm.words import TextWords
from tests.llm.brute import WORD, brute_components, brute_repeats, lowered, shingles

SF = "/root/testdata/sf0.001"

@pytest.mark.parametrize("block", [2, 5, 4096])
def test_block_names(spark, block):
    texts = ["abcdefgh", "abcdefgh", "abcdefgx", "xbcdefgh", "", None, "abab" * 4, "abab" * 4, "abab" * 5, "é" * 9, "é" * 9, "ab", "abc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.copies(docs, block=block).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    assert found == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


def test_exact_dedup_of_odd_rows(odd_table):
    rows = exact_dedup.copies(odd_table).collect()
    assert len(rows) == 10
    assert all(r.text_sha256 == hashlib.sha256(b"").hexdigest() and r.keep_id == 2 for r in rows if r.doc_id in (1, 2))
    assert sorted(r.kept for r in rows if r.doc_id == 5) == [False, True]
    assert [(r.doc_id, r.keep_id, r.kept) for r in rows if r.doc_id is None] == [(None, 6, False)]
    kept = exact_dedup.deduplicate(odd_table)
    assert kept.columns == odd_table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 7]
    assert exact_dedup.copies(odd_table.limit(0)).collect() == []


def test_exact_dedup_query(spark):
    found = QUERIES["op4_exact_dedup"](spark, SF).toPandas()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.sql(ORACLES["op4_exact_dedup"]).df()[list(found.columns)]
    assert sorted(found.itertuples(index=False)) == sorted(want.itertuples(index=False))


def test_words_are_those_of_the_pattern():
    texts = ["a b", None, "", "  x\x0bé  y", "ab", "ab c", "Ab", "z" * 3000]
    words = TextWords(pa.array(texts), lower=True)
    found = [[bytes(words.data[s:e]).decode() for s, e in zip(words.starts[a:b], words.ends[a:b], strict=True)] for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
    assert found == [WORD.findall(t or "") for t in texts]
    flat = [lowered(w) for ws in found for w in ws]
    by_hash = dict(zip(words.hashes[0].tolist(), flat, strict=True))
    assert len(by_hash) == len(set(flat)) and all(by_hash[h] == w for h, w in zip(words.hashes[0].tolist(), flat, strict=True))


def test_cover_reaches_every_difference():
    held = substring_dedup.COVER
    assert {(a - b) % substring_dedup.PERIOD for a in held for b in held} == set(range(substring_dedup.PERIOD))


def test_repeats_small(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    long = " ".join(words[:90])
    texts = {
        3: "p q r " + " ".join(words[20:60]) + " s t",
        1: long,
        2: " ".join(words[200:219]) + "  " + " ".join(words[200:219]),
        4: " ".join(words[40:59]),
        5: "u " + " ".join(words[40:60]) + "\tv",
        6: " ".join(["same"] * 50),
        7: None,
        8: long.replace(" ", "\n"),
        9: " ".join(words[100:120]) + " x " + " ".join(words[100:120]) + " y " + " ".join(words[101:121]),
    }
    monkeypatch.setattr(substring_dedup, "CHUNK", 300)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    found = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept_text).decode()) for r in substring_dedup.repeats(docs).collect()}
    order = sorted(texts.items())
    assert found == {i: w for (i, _), w in zip(order, brute_repeats(order), strict=True)}


def test_repeats_of_odd_rows(odd_table):
    rows = substring_dedup.repeats(odd_table).collect()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append((r.n_words, r.n_removed))
    assert by_id[1] == by_id[2] == by_id[3] == [(0, 0)]
    assert by_id[4] == [(54, 54)] and by_id[5][0] == by_id[5][1]
    assert substring_dedup.repeats(odd_table.limit(0)).collect() == []


def test_repeats_query(spark, texts):
    order = sorted(texts.items())
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for (i, _), (n, g, k) in zip(order, brute_repeats(order), strict=True)}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_substring_dedup"](spark, SF).collect()} == want


def test_registers_estimate_similarity():
    draw = np.random.default_rng(1)
    both = draw.integers(0, (1 << 64) - 1, 3000, np.uint64)
    a, b = np.unique(both[:2500]), np.unique(both[500:])
    near, used = near_dedup.estimate(near_dedup.registers(a), near_dedup.registers(b))
    assert used == near_dedup.BUCKETS and abs(near - 2000 / 3000) < 0.15
    assert near_dedup.estimate(near_dedup.registers(a[:0]), near_dedup.registers(a[:0])) == (0.0, 0)


def test_small_sets_meet():
    draw = np.random.default_rng(3)
    for size in (4, 9, 40, 200):
        common = draw.integers(0, (1 << 64) - 1, size, np.uint64)
        a = np.unique(common)
        b = np.unique(np.append(common, draw.integers(0, (1 << 64) - 1, size // 4, np.uint64)))
        assert np.intersect1d(near_dedup.band_keys(near_dedup.registers(a)), near_dedup.band_keys(near_dedup.registers(b))).size


def test_chains_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    texts = {100 - i: " ".join(words[4 * i : 4 * i + 60]) for i in range(30)}
    texts |= {200 + i: " ".join(words[3 * i : 3 * i + 8]).upper() for i in range(4)} | {300: "w0 w1 w2 w3 w4 w5 w6 w7", 301: "W9", 302: "w9", 303: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(2)
    sets = {i: shingles(t, 2) for i, t in texts.items()}
    want = brute_components(sets)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(docs, width=2).collect()}
    assert found == {i: (len(sets[i]), want[i], want[i] == i) for i in texts}


def test_components_of_a_long_path(spark):
    labels = spark.createDataFrame([(i, i) for i in range(60)], "row long, component long")
    links = spark.createDataFrame([(i, i + 1) for i in range(59) if i != 30], "row long, other long")
    found = {r.row: r.component for r in near_dedup.components(labels, links).collect()}
    assert found == {i: 0 if i <= 30 else 31 for i in range(60)}


def test_near_dedup_of_odd_rows(odd_table):
    rows = near_dedup.groups(odd_table, width=5).collect()
    assert len(rows) == 10
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id in (1, 2, 3)} == {(i, 0, i, True) for i in (1, 2, 3)}
    assert sorted(r.kept for r in rows if r.doc_id == 5) == [False, True]
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(6, False)]
    kept = near_dedup.deduplicate(odd_table)
    assert kept.columns == odd_table.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7]
    assert near_dedup.groups(odd_table.limit(0)).collect() == []


def test_near_dedup_query(spark, texts):
    sets = {i: shingles(t, 2) for i, t in texts.items()}
    want = brute_components(sets)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op6_near_dedup"](spark, SF).collect()}
    assert found == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_a_family_around_one_passage_makes_few_pairs(spark, monkeypatch, tmp_path):
    """1,500 texts share a passage and are similar, but not enough: no all-pairs output."""
    draw = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(int(draw.integers(8, 22))))) for i in range(1500)]
    # And two that are linked only with each other, neither of them the first of a band.
    rows += [(1500, rows[700][1] + " end"), (1501, rows[701][1] + " end")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    pairs = []
    confirmed = near_dedup.confirmed
    monkeypatch.setattr(near_dedup, "confirmed", lambda p, *rest: pairs.append(p.count()) or confirmed(p, *rest))
    found = near_dedup.groups(docs, width=2).collect()
    want = brute_components({i: shingles(t, 2) for i, t in rows})
    assert {r.doc_id: r.component_id for r in found} == want and want[1500] == 700
    assert pairs[0] < 20_000 and pairs[1] < 10
