import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gleanwork.llm import lexical
from gleanwork.llm.queries import ORACLES, QUERIES
from gleanwork.llm.words import TextWords
from tests.llm.brute import lowered
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def terms_of(text):
    return re.findall(lexical.TERMS, lowered(text or ""))


def brute(docs, items, k):
    """docs, items: lists of (id, text); (item's place, rank, doc_id, score)."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for at, (_, text) in enumerate(items):
        found = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in {*terms_of(text)} if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        for rank, (s, _, i) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k], 1):
            out.append((at, rank, i, -s))
    return out


def test_terms_are_those_of_the_pattern():
    texts = ["Ab-1 é日本x y", None, "", "--", "a_b c\x7fd", "Z" * 3000 + "!"]
    words = TextWords(pa.array(texts), lower=True, blank=lexical.PARTING)
    assert [b - a for a, b in zip(words.bounds, words.bounds[1:], strict=False)] == [len(terms_of(t)) for t in texts]


@pytest.mark.parametrize(("k", "block_docs"), [(1, 7), (3, 40), (10, 1000)])
def test_search_is_exact(spark, k, block_docs, monkeypatch):
    """Common and rare terms, ties, repeated rows, null ids, many blocks in a task."""
    monkeypatch.setattr(lexical.indexed, "__defaults__", (block_docs, 100_000))
    draw = random.Random(k)
    vocabulary = [f"w{i}" for i in range(60)]
    pick = lambda: vocabulary[min(59, int(draw.expovariate(0.12)))]
    docs = [(i, " ".join(pick() for _ in range(draw.choice([1, 5, 20, 80])))) for i in range(300)]
    docs += [(None, "w3 w4 w59"), (None, "w3 w4 w59"), (7, "w1 W2"), (7, "w1 w2"), (300, None), (301, ""), (302, "...")]
    items = [(i, " ".join(pick() for _ in range(draw.randint(1, 12)))) for i in range(40)] + [(3, "W1 w1"), (None, "w59"), (50, "nothing"), (51, None), (52, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(t for _, t in items)), "item_id long, text string")
    want = brute(docs, items, k)
    assert sorted(map(tuple, lexical.search(frame, asked, k).collect())) == sorted(want, key=lambda r: r[:2])
    in_chunks = lexical.search(frame, asked, k, chunk_terms=30).collect()
    assert sorted(map(tuple, in_chunks)) == sorted(want, key=lambda r: r[:2])


def test_accumulators_stop_and_survivors_are_exact(spark, monkeypatch):
    """A rare term decides early: the common ones make no new accumulators."""
    docs = [(i, "common words all over" + (" rare rarer" if i < 3 else "")) for i in range(500)]
    vocabulary = lexical.Vocabulary(["common", "words", "rare", "rarer"])
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    row = lexical.indexed(frame, vocabulary).collect()[0].asDict()
    df = {"common": 500, "words": 500, "rare": 3, "rarer": 3}
    weights = np.array([math.floor(1000 * math.log(1002 / (2 * df[t] + 1))) for t in vocabulary.terms])
    block = lexical.Block(row, weights, row["n_docs"], row["n_terms"])
    made = []
    real = np.flatnonzero
    monkeypatch.setattr(lexical.np, "flatnonzero", lambda a: made.append(int((np.asarray(a) != 0).sum())) or real(a))
    terms = np.array(sorted(range(4), key=lambda t: df[vocabulary.terms[t]]))
    found, scores = block.best(terms, 2, 0)
    assert found.tolist() == [0, 1] and made == [3]
    assert [tuple(r)[2:] for r in lexical.search(frame, spark.createDataFrame([(0, "common words rare rarer")], "item_id long, text string"), 2).collect()] == [(0, scores[0]), (1, scores[1])]
    assert block.best(terms, 2, int(scores[0]) + 1)[0].tolist() == [] and not block.scores.any()


def test_odd_rows(spark, odd_table):
    items = odd_table.withColumnRenamed("doc_id", "item_id").withColumn("number", odd_table.chunk)
    docs = odd_table.withColumn("score", odd_table.chunk).withColumn("rank", odd_table.row)
    rows = lexical.search(docs, items, 4).collect()
    texts = [(r.doc_id, r.text) for r in odd_table.collect()]
    want = brute(texts, texts, 4)
    assert sorted((r["rank"], r.doc_id or -1, r.score) for r in rows) == sorted((k, i or -1, s) for _, k, i, s in want)
    assert lexical.search(docs.limit(0), items).collect() == [] and lexical.search(docs, items.limit(0)).collect() == []


def test_query(spark):
    problem, rows, _ = compare(spark, connect(SF), SF, QUERIES["op11_lexical_search"], ORACLES["op11_lexical_search"])
    assert problem is None and rows > 1000
