"""Ranked lexical search, one term at a time, with limited accumulators.

Documents are cut into blocks; a block holds the postings of the terms asked for. An item's
terms are taken rarest first. Each adds its part of the score to the accumulators of the
documents that hold it, and makes new ones, until the terms that are left could not lift a
new document to the k-th best partial score, even all together at their greatest parts in
the block. From then on no accumulator is made: survivors alone are looked up in the longer
and longer lists of common terms, and one that can no longer reach the k-th best is let go.
What survives has its exact score. Bounds are strict, so ties are not lost.

A task carries an item's k best from block to block, so later blocks start with a k-th best
score to reach. Weights and lengths are those of the whole corpus. Items are answered in
chunks of bounded size, each one pass over the documents; the tasks' best are ranked once
more over all.

Terms are found by 64-bit hashes and the number of their bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanwork.llm.storage import kept
from gleanwork.llm.words import TextWords, stretches

#: What parts terms: all of ASCII but letters and digits.
PARTING = np.array([b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F for b in range(256)])
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents and postings of a block, and the terms of the items answered in one pass.
BLOCK_DOCS, BLOCK_POSTINGS, CHUNK_TERMS = 32_768, 1_000_000, 500_000
INDEX = "ids binary, lengths binary, terms binary, docs binary, counts binary, n_docs long, n_terms long"


class Vocabulary:
    """The terms asked for, in the order of their hashes."""

    def __init__(self, terms: list[str]):
        hashes = TextWords(pa.array(terms, pa.string()), blank=PARTING).hashes[0]
        order = np.argsort(hashes)
        self.terms = [terms[i] for i in order.tolist()]
        self.hashes = hashes[order]
        self.sizes = np.array([len(t.encode()) for t in self.terms], np.int64)
        #: Whether any term's hash starts with these 16 bits: most words are none of them.
        self.starts = np.zeros(1 << 16, bool)
        self.starts[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def find(self, words: TextWords) -> tuple[np.ndarray, np.ndarray]:
        """The places of known words, and their terms' numbers."""
        hashes = words.hashes[0]
        at = np.flatnonzero(self.starts[(hashes >> np.uint64(48)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = (self.hashes[term] == hashes[at]) & (self.sizes[term] == (words.ends - words.starts)[at])
        return at[same], term[same]


def indexed(docs: DataFrame, vocabulary: Vocabulary, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Blocks of documents, one row each, from (doc_id, text).

    `ids` and `lengths` are those of documents that hold any of the terms, in the order of
    the ids; postings are ordered by term and document. `n_docs` and `n_terms` count the
    documents with at least one term of whatever kind, and all their terms.
    """
    size = len(vocabulary.terms)

    def block(parts: list[tuple[np.ndarray, ...]], n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids, unnamed, lengths, doc, term, count = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, unnamed))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = place[doc]
        by = np.lexsort((doc, term))
        # An id's null is told by a byte of its own.
        named = np.concatenate([ids[order].view(np.uint8), unnamed[order].astype(np.uint8)])
        values = (named, lengths[order].astype("<i8"), term[by].astype("<i4"), doc[by].astype("<i4"), count[by].astype("<i4"))
        columns = [pa.array([v.tobytes()], pa.binary()) for v in values] + [pa.array([n], pa.int64()) for n in (n_docs, n_terms)]
        return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "terms", "docs", "counts", "n_docs", "n_terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = tuple(np.zeros(0, t) for t in (np.int64, bool, np.int64, np.int64, np.int64, np.int64))
        parts, held, postings, n_docs, n_terms = [empty], 0, 0, 0, 0
        for batch in batches:
            for begin, end in stretches(batch.column(1)):
                part = batch.slice(begin, end - begin)
                words = TextWords(part.column(1), lower=True, blank=PARTING)
                lengths = np.diff(words.bounds)
                at, term = vocabulary.find(words)
                row = np.searchsorted(words.bounds, at, "right") - 1
                pairs, count = np.unique(row * size + term, return_counts=True)
                rows, doc = np.unique(pairs // size, return_inverse=True)
                ids = part.column(0)
                unnamed = np.asarray(ids.is_null())
                named = np.asarray(ids.fill_null(0)).astype("<i8")
                parts.append((named[rows], unnamed[rows], lengths[rows], doc + held, pairs % size, count))
                held, postings = held + len(rows), postings + len(pairs)
                n_docs, n_terms = n_docs + int((lengths > 0).sum()), n_terms + int(lengths.sum())
                if held >= block_docs or postings >= block_postings:
                    yield block(parts, n_docs, n_terms)
                    parts, held, postings, n_docs, n_terms = [empty], 0, 0, 0, 0
        if n_docs:
            yield block(parts, n_docs, n_terms)

    return docs.mapInArrow(run, INDEX)


class Block:
    """A block's postings with each one's part of the score."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int):
        lengths = np.frombuffer(row["lengths"], "<i8")
        count = len(lengths)
        self.ids = np.frombuffer(row["ids"][: 8 * count], "<i8")
        self.unnamed = np.frombuffer(row["ids"][8 * count :], np.uint8)
        self.docs = np.frombuffer(row["docs"], "<i4")
        term, tf = np.frombuffer(row["terms"], "<i4"), np.frombuffer(row["counts"], "<i4").astype(np.int64)
        m = 50 + 50 * lengths * n // total
        self.parts = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs]))
        self.bounds = np.searchsorted(term, np.arange(len(weights) + 1))
        self.greatest = np.zeros(len(weights), np.int64)
        if len(term):
            present = np.flatnonzero(np.diff(self.bounds))
            self.greatest[present] = np.maximum.reduceat(self.parts, self.bounds[present])
        self.scores = np.zeros(count, np.int64)

    def best(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents of at least the score `floor` (above 0), by (score, place),
        and their scores. `terms` come rarest first."""
        rest = np.append(np.cumsum(self.greatest[terms][::-1])[::-1], 0)
        scores, at = self.scores, 0
        touched = []
        # A k-th best partial score above what is left ends the making of accumulators.
        while at < len(terms) and rest[at] >= floor:
            begin, end = self.bounds[terms[at] : terms[at] + 2]
            docs = self.docs[begin:end]
            scores[docs] += self.parts[begin:end]
            touched.append(docs)
            at += 1
            if len(docs) and rest[at] < rest[0] - rest[at]:
                top = np.partition(scores, -k)[-k] if len(scores) > k else 0
                floor = max(floor, int(top))
        held = np.flatnonzero(scores)
        values = scores[held]
        for docs in touched:
            scores[docs] = 0
        for t in range(at, len(terms)):
            alive = values + rest[t] >= floor
            held, values = held[alive], values[alive]
            begin, end = self.bounds[terms[t] : terms[t] + 2]
            if begin < end and len(held):
                docs = self.docs[begin:end]
                where = np.minimum(np.searchsorted(docs, held), end - begin - 1)
                values = values + np.where(docs[where] == held, self.parts[begin:end][where], 0)
            if len(values) > k:
                floor = max(floor, int(np.partition(values, -k)[-k]))
        fit = (values >= floor) & (values > 0)
        held, values = held[fit], values[fit]
        order = np.lexsort((held, -values))[:k]
        return held[order], values[order]


def _answered(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): for each item, by its place in the list, the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], weights, n, total)
                for item, terms in enumerate(items):
                    ids, unnamed, scores = best[item]
                    docs, found = block.best(terms, k, int(scores[-1]) if len(scores) == k else 0)
                    if len(docs):
                        ids, unnamed = np.concatenate([ids, block.ids[docs]]), np.concatenate([unnamed, block.unnamed[docs]])
                        scores = np.concatenate([scores, found])
                        order = np.lexsort((ids, unnamed, -scores))[:k]
                        best[item] = ids[order], unnamed[order], scores[order]
        for item, (ids, unnamed, scores) in enumerate(best):
            if len(ids):
                columns = [pa.array(np.full(len(ids), item, np.int32)), pa.array(ids, mask=unnamed.astype(bool)), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return index.select("ids", "lengths", "terms", "docs", "counts").mapInArrow(run, "item int, doc_id long, score long")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    chunk_terms: int = CHUNK_TERMS,
) -> DataFrame:
    """Each item's k best documents: item_id, rank (from 1), doc_id, score above 0.

    Terms are runs of characters other than ASCII marks, blanks and controls, in whole texts,
    A-Z in lower case. With N documents that have terms and L terms in all, a term held by df
    documents weighs floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms that holds it
    tf times gets weight * (10**9 tf div (1000 tf + 20 m)) for it, m = 50 + 50 n N div L.
    An item's terms count once each. Equal scores go by doc_id, null ids last.

    Null and empty texts have no terms: such documents are never found, such items find
    nothing. Repeated documents are found each; repeated items (or ids) are answered each.
    Empty tables give no rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    low = F.translate(F.col(item_text), UPPER, LOWER)
    terms = F.array_distinct(F.regexp_extract_all(low, F.lit(TERMS), F.lit(0)))
    asked = kept(items.select(F.monotonically_increasing_id().alias("number"), F.col(item_id).alias("item_id"), terms.alias("terms")))
    asked = asked.filter(F.size("terms") > 0)
    chunks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // chunk_terms)
    answers = None
    for chunk in range(chunks):
        some = asked.filter(F.pmod(F.xxhash64("number"), F.lit(chunks)) == chunk)
        found = kept(_chunk(rows, some.select("number", "terms").collect(), k))
        answers = found if answers is None else answers.unionByName(found)
    if answers is None:
        answers = asked.sparkSession.createDataFrame([], "number long, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def _chunk(rows: DataFrame, asked: list, k: int) -> DataFrame:
    """(number, doc_id, score) for some items, whose terms one task can hold."""
    spark = rows.sparkSession
    vocabulary = Vocabulary(sorted({t for item in asked for t in item.terms}))
    size = len(vocabulary.terms)
    index = kept(indexed(rows, vocabulary))
    totals = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for terms in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(terms, "<i4"), minlength=size)
        term = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(counts[term])], ["term", "df"])

    df = np.zeros(size, np.int64)
    for row in index.select("terms").mapInArrow(held, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[row.term] = row.df
    n, total = totals
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
    number = {t: i for i, t in enumerate(vocabulary.terms)}
    terms = [np.array(sorted((number[t] for t in item.terms if df[number[t]]), key=lambda t: (df[t], t)), np.int64) for item in asked]
    found = _answered(index, terms, weights, n, total or 1, k)
    numbers = spark.createDataFrame([(i, item.number) for i, item in enumerate(asked)], "item int, number long")
    return found.join(F.broadcast(numbers), "item").select("number", "doc_id", "score")
