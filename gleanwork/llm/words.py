"""Words of many texts at once, as hashes, over the bytes of an Arrow column.

A word is a run of bytes other than the ASCII blanks 0x20 and 0x09-0x0D; these never occur
inside a UTF-8 character. Everything is numpy over bounded stretches of bytes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time: arrays of eight bytes each stay near the cache.
STRETCH = 1 << 20
BASE = 0x9E3779B97F4A7C15
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers after which every bit depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=4)
def _letters(seed: int) -> np.ndarray:
    """A random odd number for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    both = []
    for base in (BASE, inverse):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        both.append(np.multiply.accumulate(powers))
    return both[0], both[1]


class TextWords:
    """The words of consecutive rows: their bytes' places, their hashes, and whose they are.

    Words i with bounds[r] <= i < bounds[r + 1] belong to row r. `blank` says for each byte
    whether it parts words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, seeds: tuple[int, ...] = (1,), blank: np.ndarray = BLANK):
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        size = len(texts)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + size + 1].astype(np.int64)
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if size else np.zeros(1, np.int64)
        inside = ~blank[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < len(self.data)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        last[ends] = inside[ends]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        data = LOWER[self.data] if lower else self.data
        self.hashes = [self._hashed(data, seed) for seed in seeds]

    def _hashed(self, data: np.ndarray, seed: int) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        letters = _letters(seed)
        at = 0
        while at < len(out):
            begin = self.starts[at]
            to = max(at + 1, int(np.searchsorted(self.ends, begin + STRETCH, "right")))
            piece = data[begin : self.ends[to - 1]]
            powers, inverses = _powers(max(STRETCH, len(piece)))
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(letters[piece] * powers[: len(piece)], out=sums[1:])
            starts = self.starts[at:to] - begin
            out[at:to] = (sums[self.ends[at:to] - begin] - sums[starts]) * inverses[starts]
            at = to
        return mixed(out)

    def runs(self, length: int, which: int = 0) -> np.ndarray:
        """For each word, a hash of the `length` words from it on (across rows, too)."""
        hashes = self.hashes[which]
        count = len(hashes) - length + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(count, np.uint64)
        for i in range(length):
            out = out * np.uint64(BASE) + hashes[i : i + count]
        return mixed(out)


def stretches(texts: pa.Array, limit: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes of text, of one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, to
        at = to
