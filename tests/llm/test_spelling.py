import random
import re
import zlib
from collections import Counter

import pytest

from gleanwork.llm import spelling
from gleanwork.llm.queries import ORACLES, QUERIES, _misheard
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute(words, ratio=5):
    out = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if abs(len(v) - len(w)) < 2 and edits(v, w) == 1]
        best = min(near, default=None)
        out[w] = (best[1] if best and -best[0] >= ratio * n else None, n, len(near))
    rows = []
    for w, (form, n, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, count, words[form] if form else None))
    return sorted(rows)


@pytest.mark.parametrize("symbols", [2, 5, 8])
def test_variants_are_those_of_all_pairs(spark, symbols):
    draw = random.Random(symbols)
    letters = "abcdeéèÿz"
    words = {}
    while len(words) < 250:
        w = "".join(draw.choice(letters) for _ in range(draw.randint(1, 5)))
        words[w] = draw.choice([1, 2, 7, 40, 200, 1000])
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(frame, 5, symbols).collect())) == brute(words)


def test_long_chains_and_ties(spark):
    words = {"a" * (6 + i): 5 * 5**i for i in range(9)} | {"bbbbbba": 100, "bbbbbbc": 100, "bbbbbb": 5, "": 9}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    found = {r.word: r for r in spelling.variants(frame).collect()}
    assert found["aaaaaa"].root == "a" * 14 and found["a" * 14].root == "a" * 14
    assert (found["bbbbbb"].form, found["bbbbbb"].n_near) == ("bbbbbba", 2) and found[""].n_near == 0
    assert spelling.variants(frame.limit(0)).collect() == []


def test_counts_of_odd_rows(spark, odd_table):
    found = {r.word: r.n for r in spelling.counted(odd_table, 1, 1).collect()}
    want = Counter()
    for r in odd_table.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            want["".join(c.lower() if c.isascii() else c for c in run)] += 1
    assert found == want
    assert spelling.counted(odd_table.limit(0)).collect() == []


def test_query(spark):
    problem, rows, _ = compare(spark, connect(SF), SF, QUERIES["op12_spelling_variants"], ORACLES["op12_spelling_variants"])
    assert problem is None and rows > 100


def test_query_against_plain_python(spark):
    words = Counter()
    for doc in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", doc.text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc.doc_id}:{low}".encode())
            words[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 199 == 0 else low] += 1
    held = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    found = spelling.counted(spark.read.parquet(f"{SF}/documents.parquet"), heard=_misheard).collect()
    assert {r.word: r.n for r in found} == held
    assert sorted(map(tuple, QUERIES["op12_spelling_variants"](spark, SF).collect())) == brute(held)
