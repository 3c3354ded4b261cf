"""Counting the tokens of byte-level BPE without emitting them.

Byte-pair merging over a doubly linked list of symbols with a heap of adjacent pairs: the
pair of the lowest rank, the leftmost of equals, is popped and merged until none is left.
Every merge removes one symbol, so the count is the initial symbols less the merges; no
identifier is looked up at the end.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.segments import SEGMENTS, Memo

#: Fixed value: the splitting pattern that the byte-level pre-tokenizer has built in.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The character that stands for each byte in the files of byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from 256 on.
    """
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class HeapCounter:
    """Token counts for one table of merges: (left, right) in the order of their ranks."""

    def __init__(self, merges: list[tuple[str, str]]):
        names: dict[str, int] = {}
        for symbol in byte_symbols():
            names.setdefault(symbol, len(names))
        self.first = list(range(256))
        self.merged: dict[int, tuple[int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            a = names.setdefault(left, len(names))
            b = names.setdefault(right, len(names))
            self.merged[a << 32 | b] = (rank, names.setdefault(left + right, len(names)))

    def count(self, piece: bytes) -> int:
        """The number of tokens of one match of the splitting pattern."""
        symbols = [self.first[b] for b in piece]
        size = left = len(symbols)
        if size < 2:
            return size
        lookup = self.merged.get
        heap = []
        for at in range(size - 1):
            if pair := lookup(symbols[at] << 32 | symbols[at + 1]):
                heap.append((pair[0], at))
        heapq.heapify(heap)
        following, previous = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            rank, at = heapq.heappop(heap)
            other = following[at]
            if symbols[at] < 0 or other >= size:
                continue
            pair = lookup(symbols[at] << 32 | symbols[other])
            if pair is None or pair[0] != rank:
                continue  # a neighbour was merged away since the pair was pushed
            symbols[at], symbols[other] = pair[1], -1
            behind = following[at] = following[other]
            left -= 1
            if behind < size:
                previous[behind] = at
                if pair := lookup(symbols[at] << 32 | symbols[behind]):
                    heapq.heappush(heap, (pair[0], at))
            before = previous[at]
            if before >= 0 and (pair := lookup(symbols[before] << 32 | symbols[at])):
                heapq.heappush(heap, (pair[0], before))
        return left


def read_model(path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """The merges and the added tokens of a tokenizer file.

    Raises ValueError if the file asks for something other than plain byte-level BPE.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splitter = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec["normalizer"] is None
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter.get("add_prefix_space")
        and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    )
    if not plain:
        raise ValueError(f"{path} is no plain byte-level BPE")
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return merges, [t["content"] for t in spec["added_tokens"]]


@functools.lru_cache(maxsize=2)
def _counter(path: str):
    """Once per worker: a function from a text to its number of tokens."""
    import regex

    matches = regex.compile(BYTE_LEVEL).findall
    merges, added = read_model(path)
    pieces = Memo(HeapCounter(merges).count, 200_000)

    def count(segment: str) -> int:
        return sum([pieces[m.encode()] for m in matches(segment)])

    counts = Memo(count)
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def of(text: str) -> int:
        parts = special.split(text) if special else [text]
        return len(parts) - 1 + sum([sum(map(counts.__getitem__, SEGMENTS(p))) for p in parts])

    return of


def count_tokens(text: Column, path: str) -> Column:
    """The number of tokens of a text by the tokenizer file at `path`, as a long.

    An added token's string inside a text counts as that one token, as the library of these
    files does by default; no token is added at either end, nothing is truncated or padded.
    Null and empty texts have no tokens.
    """

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = _counter(path)
        for texts in batches:
            yield pd.Series([of(t) if t else 0 for t in texts], dtype="int64")

    return counts(text)


def with_counts(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """The frame with n_bytes (UTF-8), n_tokens and over_limit (more tokens than `limit`).

    Columns of these names are replaced, all others stay, whatever their names. Rows are
    handled one by one: null and empty texts count nothing, repeated rows are repeated, and an
    empty table stays empty. Long texts are counted whole, piece by piece.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn("n_bytes", F.octet_length(whole).cast("long")).withColumn("n_tokens", count_tokens(whole, path))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
