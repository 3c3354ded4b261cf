"""Byte-level BPE encoding and decoding as a monoid reduced over a tree.

The encodings of two neighbouring strings join to the encoding of the whole, so a piece is
encoded by halves: each half on its own, then the seam is mended. Byte-pair merging takes
the lowest rank first, the leftmost of equals. From that follows the rule used at a seam:

    a sequence of tokens is what merging gives for its bytes if and only if every two
    neighbours x, y are *stable*, that is if merging the bytes of x and y alone gives x, y.

(Until the first merge that crosses a token's border, merging the whole and merging two
neighbours alone take the same steps inside those two; the first crossing merge would then
also happen in the pair alone.) A join whose seam is stable is a concatenation. Otherwise
the bytes of a window around the seam are merged anew, and the window grows on the side
whose border is not stable yet; tokens outside a window with stable borders are proven.

Decoding is the same reduction with concatenation as its operation.
"""

from __future__ import annotations

import base64
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.segments import SEGMENTS, Memo


class TreeBpe:
    """Encoder and decoder for one table of ranks; a token's id is its rank."""

    #: Halves up to this many bytes are kept; words share most of their halves.
    MEMO_BYTES = 12
    #: Ids decoded in one go at the leaves of the decoding tree.
    LEAF = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        if None in self.single:
            raise ValueError("every single byte must be a token")
        self.halves: Memo = Memo(self._split, 100_000)
        self.windows: Memo = Memo(self._window, 200_000)

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one match of the splitting pattern."""
        if len(piece) <= self.MEMO_BYTES:
            return self.halves[piece]
        return self._split(piece)

    def _split(self, piece: bytes) -> tuple[int, ...]:
        if len(piece) < 2:
            return (self.single[piece[0]],) if piece else ()
        middle = len(piece) >> 1
        return self.join(self.encode(piece[:middle]), self.encode(piece[middle:]))

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The ids of two neighbouring strings together, from the ids of each."""
        if not left or not right:
            return left + right
        windows = self.windows
        start, end, step = len(left) - 1, 1, 1
        while True:
            old = left[start:] + right[:end]
            window = windows[old]
            if window == old and step == 1:
                return left + right
            # Stable borders: the pair across each is what merging gives for its bytes.
            fixed_left = start == 0 or windows[pair := (left[start - 1], window[0])] == pair
            fixed_right = end == len(right) or windows[pair := (window[-1], right[end])] == pair
            if fixed_left and fixed_right:
                return left[:start] + window + right[end:]
            if not fixed_left:
                start = max(0, start - step)
            if not fixed_right:
                end = min(len(right), end + step)
            step *= 2

    def _window(self, ids: tuple[int, ...]) -> tuple[int, ...]:
        return self.merge(b"".join([self.bytes_of[i] for i in ids]))

    def merge(self, window: bytes) -> tuple[int, ...]:
        """Byte-pair merging of a window by its definition, without the tree.

        One sweep merges all pairs of the lowest rank from left to right; it breaks off if a
        merge makes a pair of a still lower rank, which then has its turn.
        """
        rank_of = self.ranks.get
        parts = [window[i : i + 1] for i in range(len(window))]
        while len(parts) > 1:
            ranks = [rank_of(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            found = [r for r in ranks if r is not None]
            if not found:
                break
            lowest = min(found)
            swept: list[bytes] = []
            at, last = 0, len(parts) - 1
            while at < last:
                if ranks[at] != lowest:
                    swept.append(parts[at])
                    at += 1
                    continue
                merged = parts[at] + parts[at + 1]
                before = rank_of(swept[-1] + merged) if swept else None
                after = rank_of(merged + parts[at + 2]) if at + 2 <= last else None
                swept.append(merged)
                at += 2
                if (before is not None and before < lowest) or (after is not None and after < lowest):
                    break
            parts = swept + parts[at:]
        return tuple(self.ranks[p] for p in parts)

    def decode(self, ids: list[int]) -> bytes | None:
        """The bytes of the ids; None if one of them is no token."""
        table = self.bytes_of
        try:
            level = [
                b"".join([table[i] for i in ids[at : at + self.LEAF]])
                for at in range(0, len(ids), self.LEAF)
            ]
        except KeyError:
            return None
        while len(level) > 1:
            odd = [level.pop()] if len(level) % 2 else []
            level = [a + b for a, b in zip(level[::2], level[1::2], strict=True)] + odd
        return level[0] if level else b""


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


@functools.lru_cache(maxsize=2)
def _coder(path: str, pattern: str) -> tuple[TreeBpe, Memo]:
    """Once per worker: the coder, and the packed ids of segments."""
    import regex

    matches = regex.compile(pattern).findall
    bpe = TreeBpe(read_ranks(path))

    def pack(segment: str) -> bytes:
        ids = [i for match in matches(segment) for i in bpe.encode(match.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    return bpe, Memo(pack)


def encode(text: Column, path: str, pattern: str) -> Column:
    """The ids of a text as binary: little-endian unsigned 32-bit integers.

    Special tokens have no meaning here: their strings are ordinary text. Null and empty
    texts give no ids (an empty binary). `path` names a rank file every worker can read;
    `pattern` is the pattern that splits the text, whose matches are encoded separately.
    """

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _, packed = _coder(path, pattern)
        for texts in batches:
            yield pd.Series(
                [b"".join(map(packed.__getitem__, SEGMENTS(t))) if t else b"" for t in texts],
                dtype=object,
            )

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of packed ids as `encode` gives them.

    Null for null and for ids outside the vocabulary; no ids give no bytes.
    """

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe, _ = _coder(path, pattern)
        for packed in batches:
            yield pd.Series(
                [None if p is None else bpe.decode(np.frombuffer(p, "<u4").tolist()) for p in packed],
                dtype=object,
            )

    return decoded(ids)


def round_trip(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded"
) -> DataFrame:
    """The frame with the packed ids of its texts and the bytes those ids decode to.

    Columns of the names given for `ids` and `decoded` are replaced; all others stay. Rows
    are handled one by one: null and empty texts have no ids, repeated rows are repeated in
    the result, an empty table gives an empty one. Long texts, and long pieces of them, are
    encoded whole: a piece's halves are, and theirs, so no piece is too long.
    """
    coded = docs.withColumn(ids, encode(F.col(text), path, pattern))
    return coded.withColumn(decoded, decode(F.col(ids), path, pattern))
