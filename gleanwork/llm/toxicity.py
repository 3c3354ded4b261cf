"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, each hashed to a bucket with an embedding; a
text is the mean of its words, and a linear softmax tells its class. Embeddings and softmax
are trained together, in numpy on the driver, on a bounded sample of labelled rows. A
misspelt word the sample never held shares most n-grams, and so its vector, with the word.

Once trained, an embedding counts only by its product with the difference of the two class
weights, so a model is one number per bucket and an offset: its size is fixed, and scoring
a text is a mean over its words.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.segments import Memo, words

#: Buckets of n-grams; ids fit 16 bits.
BUCKETS = 1 << 16
#: Lengths of n-grams, taken from the word with marks for its start and end.
GRAMS = (4, 6)
#: Labelled rows a model is fitted on, at most. They are chosen by a hash of their id.
SAMPLE = 6000
#: Words without meaning that every text is taken to have besides its own, so that a text
#: of three words is not judged by one of them.
PRIOR = 10
POWER = 2.0
#: Buckets in fewer texts of the sample tell nothing and have no weight.
MIN_TEXTS = 4
#: Word means are a few hundredths; this brings their products near one.
SCALE = 16.0


def buckets(word: str) -> list[int]:
    """The buckets of a word's n-grams, letter case put aside."""
    marked = f"<{word.lower()}>"
    grams = [marked] + [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


def features(text: str | None) -> tuple[bytes, bytes]:
    """The buckets of a text and their shares in the mean of its words, packed."""
    counts = Counter(words(text or ""))
    total = sum(counts.values()) + PRIOR
    share: dict[int, float] = {}
    for word, count in counts.items():
        found = buckets(word)
        each = count / total / len(found)
        for bucket in found:
            share[bucket] = share.get(bucket, 0.0) + each
    held = sorted(share)
    return np.array(held, "<u2").tobytes(), np.array([share[b] for b in held], "<f4").tobytes()


@dataclass(frozen=True)
class Model:
    """What a bucket adds to the log-odds of the toxic class, the offset, and whether there
    were rows of both classes to learn from."""

    weights: np.ndarray
    offset: float
    learned: bool = True

    def log_odds(self, word: str) -> float:
        return float(self.weights[buckets(word)].mean())


def fit(rows: list[tuple[bytes, bytes]], labels: list[int], size: int = 4, steps: int = 600, batch: int = 64, rate: float = 0.05, decay: float = 2e-4, seed: int = 7) -> Model:
    """Train embeddings and softmax together by Adam on mini-batches.

    Without rows of both classes the model is the share of toxic rows (half, without any).
    """
    share = (sum(labels) + 1) / (len(labels) + 2)
    if not 0 < sum(labels) < len(labels):
        return Model(np.zeros(BUCKETS, "f4"), math.log(share / (1 - share)), learned=False)
    random = np.random.default_rng(seed)
    texts_with = np.zeros(BUCKETS, np.int64)
    for bag, _ in rows:
        texts_with[np.frombuffer(bag, "<u2")] += 1
    common = texts_with >= MIN_TEXTS
    # What most texts hold tells little; its share is scaled down.
    rarity = np.where(common, np.log((1 + len(rows)) / np.maximum(texts_with, 1)) ** POWER, 0).astype("f4")
    held = []
    for bag, shares in rows:
        index, weight = np.frombuffer(bag, "<u2"), np.frombuffer(shares, "<f4")
        held.append((index[common[index]], (weight * rarity[index])[common[index]] * SCALE))
    toxic = np.array(labels)
    embedding = random.normal(0, 0.1, (BUCKETS, size)).astype("f4")
    softmax = random.normal(0, 0.5, (size, 2)).astype("f4")
    bias = np.log(np.array([1 - share, share], "f4"))
    parameters = [embedding, softmax, bias]
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step = 0
    epochs = -(-steps * batch // len(held))
    for epoch in range(epochs):
        order = random.permutation(len(held))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            chosen = [i for i in order[at : at + batch] if held[i][0].size]
            if not chosen:
                continue
            index = np.concatenate([held[i][0] for i in chosen]).astype(np.int64)
            weight = np.concatenate([held[i][1] for i in chosen])
            starts = np.cumsum([0] + [held[i][0].size for i in chosen[:-1]])
            mean = np.add.reduceat(embedding[index] * weight[:, None], starts)
            logits = mean @ softmax + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            slope = odds / odds.sum(axis=1, keepdims=True)
            slope[np.arange(len(chosen)), toxic[chosen]] -= 1
            slope /= len(chosen)
            back = (slope @ softmax.T)[np.repeat(np.arange(len(chosen)), [held[i][0].size for i in chosen])] * weight[:, None]
            into = np.stack([np.bincount(index, back[:, d], BUCKETS) for d in range(size)], axis=1).astype("f4")
            slopes = [into + decay * embedding, mean.T @ slope, slope.sum(axis=0)]
            step += 1
            for p, g, m, v in zip(parameters, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    difference = softmax[:, 1] - softmax[:, 0]
    return Model((embedding @ difference * rarity * SCALE).astype("f4"), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Fit a model on at most `sample` labelled rows, those of the smallest hash of their id.

    Only the sample's bags of buckets reach the driver, each bounded by the number of
    buckets. Rows without a label, an id or a text are left out; an id labelled twice counts
    as toxic if one of its labels is, and of rows that share an id one text is taken, that
    of the least hash.
    """
    marked = labels.filter(F.col(target).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(F.col(target).cast("int")).alias("_label"))
    chosen = marked.orderBy(F.xxhash64(doc_id), doc_id).limit(sample)

    @F.pandas_udf("struct<held: binary, shares: binary>")
    def bags(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t) for t in texts], columns=["held", "shares"])

    # The chosen ids are at most `sample` rows of two numbers; of an id's texts one is taken.
    joined = docs.select(doc_id, text).filter(F.col(text).isNotNull()).join(F.broadcast(chosen), doc_id)
    one = joined.groupBy(doc_id, "_label").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("_text"))
    rows = one.select(doc_id, "_label", bags(F.col("_text")).alias("bag")).select(doc_id, "_label", "bag.*").toArrow().sort_by(doc_id)
    toxic = [int(x > 0) for x in rows["_label"].to_pylist()]
    # The bags are read where Arrow holds them.
    return fit(list(zip(*(_views(rows[c].combine_chunks()) for c in ("held", "shares")), strict=True)), toxic)


def _views(column: pa.Array) -> list[memoryview]:
    """The bytes of each row of a binary column, not copied."""
    if not len(column):
        return []
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    return [data[i:j] for i, j in zip(ends, ends[1:], strict=False)]


def score(text: Column, model: Model) -> Column:
    """The probability of the toxic class for every whole text.

    Null, empty and blank texts have no words and get the model's offset alone.
    """

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Memo(model.log_odds)
        for texts in batches:
            out = []
            for t in texts:
                found = words(t) if t else []
                odds = model.offset + sum(map(known.__getitem__, found)) / (len(found) + PRIOR)
                out.append(1 / (1 + math.exp(-max(-60.0, min(60.0, odds)))))
            yield pd.Series(out, dtype="float64")

    return scores(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row is left out of training: a quarter of all, by a checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The frame with held_out, score and predicted (1 if the score reaches the threshold).

    The model learns from labels of rows that are not held out, and from their texts alone.
    Columns of these names are replaced, all others stay; rows are scored one by one, and an
    empty table or one without labels is no error (every score is then one half).
    """
    model = train(docs, labels.filter(~held_out(doc_id)), doc_id=doc_id, text=text)
    scored = docs.withColumn("held_out", held_out(doc_id)).withColumn("score", score(F.col(text), model))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
