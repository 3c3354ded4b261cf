"""Packing tokenised documents into windows of a fixed size.

A document's ids are cut into full windows and one rest. Rests are packed by non-negative
least squares: shallow combinations of lengths that fill a window are enumerated, the
repeat counts that best explain the histogram of lengths are solved for, rounded and
carried out; what is left over is packed greedily.

The rests are dealt by a hash to groups of a bounded mean size, and each group is packed on
its own by one task. A group of tens of thousands of rests has a histogram as dense as the
whole, so more groups cost no padding to speak of, and the work grows with the input over
more tasks, never within one.
"""

from __future__ import annotations

import array
import bisect
import functools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm.segments import Memo
from gleanwork.llm.storage import kept
from gleanwork.llm.words import TextWords

#: Mean number of pieces of a group that one task packs.
GROUP_PIECES = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Bytes that stay with the word before them, and those that end a letter or digit: ASCII ones
#: and the second byte of Latin-1 letters.
TRAILING = np.isin(np.arange(256), [*b".,", 0x20, *range(0x09, 0x0E)])
WORDLIKE = np.array([chr(b).isalnum() for b in range(128)] + [False] * 128)
LATIN = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])


class Encoder:
    """Once per worker: the ids of a batch of texts.

    The tokenizer drops white space and never merges across it, nor from a letter or digit to
    a mark, and it lower-cases. So texts are cut in front of words, and between a word and the
    full stops, commas and blanks behind it. The slices are dictionary-encoded where they lie in the
    batch's bytes, lower-cased and dictionary-encoded again; each different one is encoded
    once, and the texts' ids are gathered from these.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode_batch = Tokenizer.from_file(path).encode_batch_fast
        self.found = Memo(None, 600_000)

    @staticmethod
    def slices(cut_texts: TextWords) -> tuple[np.ndarray, np.ndarray]:
        """Where each slice begins, the last one's end behind them, and each word's first slice."""
        data, starts = cut_texts.data, cut_texts.starts
        last = np.where(TRAILING[data], 0, np.arange(len(data)))
        np.maximum.accumulate(last, out=last)
        at = last[np.append(starts[1:], cut_texts.ends[-1]) - 1]
        wordlike = WORDLIKE[data[at]] | (LATIN[data[at]] & (data[np.maximum(at - 1, 0)] == 0xC3))
        split = (at >= starts) & wordlike
        begins = np.sort(np.concatenate([starts, at[split] + 1]))
        firsts = np.arange(len(starts)) + np.cumsum(split) - split
        return np.append(begins, cut_texts.ends[-1]), firsts

    def coded(self, slices: list[str]) -> list[bytes]:
        """The packed ids (little-endian, 32 bits) of each slice."""
        young, old = self.found.get, self.found.old.get
        values = [young(s) or old(s) for s in slices]
        new = [at for at, v in enumerate(values) if v is None]
        for at, got in zip(new, self.encode_batch([slices[at] for at in new], add_special_tokens=False) if new else (), strict=True):
            values[at] = value = array.array("I", got.ids).tobytes()
            self.found.keep(slices[at], value)
        return values

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, the end id behind each, and where each text begins (and the last ends)."""
        cut_texts = TextWords(texts, seeds=())
        if not len(cut_texts.starts):
            return np.full(len(texts), end_id, "<u4"), np.arange(len(texts) + 1)
        offsets, firsts = self.slices(cut_texts)
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(cut_texts.data)]
        held = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).dictionary_encode()
        # A special token's string in other case is none: such slices stay as they are.
        low = pc.if_else(pc.match_substring(held.dictionary, "<|"), held.dictionary, pc.ascii_lower(held.dictionary)).dictionary_encode()
        values = self.coded(low.dictionary.to_pylist())
        sizes = np.array([len(v) for v in values], np.int64) // 4
        ids, begins = np.frombuffer(b"".join(values), "<u4"), np.cumsum(sizes) - sizes
        word = low.indices.to_numpy()[held.indices.to_numpy()]
        each = sizes[word]
        ends = np.cumsum(each)
        taken = ids[np.arange(ends[-1]) + np.repeat(begins[word] - (ends - each), each)]
        bounds = np.append(0, ends)[np.append(firsts, len(word))[cut_texts.bounds]]
        return np.insert(taken, bounds[1:], end_id).astype("<u4"), bounds + np.arange(len(bounds))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(docs: DataFrame, path: str, window: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece of a document: its ids and the end id, cut into windows and a rest.

    Null and empty texts are a piece of the end id alone. Columns: doc_id, start, length,
    ids_crc32, doc_tokens.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            ids, bounds = encode(batch.column(1), end_id)
            totals = np.diff(bounds)
            counts = -(-totals // window)
            doc = np.repeat(np.arange(len(totals)), counts)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
            length = np.minimum(window, totals[doc] - start)
            at = bounds[:-1][doc] + start
            checks = [zlib.crc32(ids[i:j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(checks, pa.int64()), pa.array(totals[doc])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(pieces, PIECES)


def combinations(lengths: np.ndarray, window: int, slack: int, seconds: int = 6) -> list[tuple[int, ...]]:
    """Combinations of one to three of the lengths that fill the window up to the slack.

    Of two lengths all that fit are listed. Of three, each shortest one meets a few second
    ones, evenly spread, with the longest third one that fits: the list stays linear in the
    number of different lengths, and its repeat counts large enough to be rounded.
    """
    held = sorted(set(lengths.tolist()))
    found = [(a,) for a in held if a >= window - slack]
    for i, a in enumerate(held):
        for at in range(bisect.bisect_left(held, window - slack - a), bisect.bisect_right(held, window - a)):
            if at >= i:
                found.append((a, held[at]))
    for i, a in enumerate(held):
        past = bisect.bisect_right(held, (window - a) // 2)
        for j in range(i, past, max(1, (past - i) // seconds)):
            b = held[j]
            at = bisect.bisect_right(held, window - a - b) - 1
            if at >= j and a + b + held[at] >= window - slack:
                found.append((a, b, held[at]))
    return found


def nonnegative_least_squares(columns: np.ndarray, weights: np.ndarray, target: np.ndarray, rounds: int = 60) -> np.ndarray:
    """x >= 0 with a small |A x - target|, A sparse.

    Column c of A has weights[c, k] in row columns[c, k]. Projected gradient steps, scaled by
    the column sums so that each step lowers the error; a few dozen suffice, as the counts
    are rounded anyway.
    """
    rows = target.size
    touched = np.zeros(rows)
    np.add.at(touched, columns, np.abs(weights))
    scale = (weights * touched[columns]).sum(axis=1)
    x = np.zeros(len(columns))
    momentum, t = x.copy(), 1.0
    for _ in range(rounds):
        error = -target.astype(float)
        error += np.bincount(columns.ravel(), (weights * momentum[:, None]).ravel(), rows)
        step = np.maximum(0, momentum - (weights * error[columns]).sum(axis=1) / scale)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        momentum = step + (t - 1) / t_next * (step - x)
        x, t = step, t_next
    return x


def plan(lengths: np.ndarray, window: int, slack: int) -> list[list[int]]:
    """Bins of indexes into `lengths`, each of at most `window` tokens; every index once."""
    held: dict[int, list[int]] = defaultdict(list)
    for index in np.argsort(lengths, kind="stable").tolist():
        held[int(lengths[index])].append(index)
    bins: list[list[int]] = [[i] for i in held.pop(window, [])]
    levels = np.array(sorted(held))
    counts = np.array([len(held[int(v)]) for v in levels])
    if levels.size:
        options = combinations(levels, window, slack)
        if options:
            where = {int(v): k for k, v in enumerate(levels)}
            columns = np.array([[where[v] for v in (*o, *o[:1] * (3 - len(o)))] for o in options])
            weights = np.array([[1.0] * len(o) + [0.0] * (3 - len(o)) for o in options])
            repeats = nonnegative_least_squares(columns, weights, counts)
            for k in np.argsort(-repeats, kind="stable").tolist():
                wanted = options[k]
                for _ in range(round(repeats[k])):
                    if not all(len(held[v]) >= wanted.count(v) for v in wanted):
                        break
                    bins.append([held[v].pop() for v in wanted])
    return bins + _greedy({v: found for v, found in held.items() if found}, window)


def _greedy(held: dict[int, list[int]], window: int) -> list[list[int]]:
    """The longest piece first, then always the longest that still fits."""
    levels = sorted(held)
    bins = []
    while levels:
        room, filled = window, []
        while (at := bisect.bisect_right(levels, room) - 1) >= 0:
            longest = levels[at]
            filled.append(held[longest].pop())
            room -= longest
            if not held[longest]:
                levels.pop(at)
        bins.append(filled)
    return bins


def pack(pieces: DataFrame, groups: int, window: int, slack: int) -> DataFrame:
    """The pieces with the sequence each goes to and its offset there, without gaps.

    A sequence's id is its number within the group and the group's number; ids are unique,
    not dense. Rows are dealt to the groups by their number, so equal ones spread like any
    others, and are packed as separate pieces. Give a table: rows are numbered as they are read.
    """
    schema = f"{PIECES}, sequence_id long, offset long"

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32"], na_position="first").reset_index(drop=True)
        group = int(frame["group"].iloc[0])
        length = frame["length"].to_numpy()
        sequence, offset = np.zeros(len(frame), "int64"), np.zeros(len(frame), "int64")
        for number, members in enumerate(plan(length, window, slack)):
            ends = np.cumsum(length[members])
            sequence[members] = number * groups + group
            offset[members] = ends - length[members]
        return frame.drop(columns="group").assign(sequence_id=sequence, offset=offset)

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(packed, schema)


def pack_documents(
    docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, slack: int = 8,
    group_pieces: int = GROUP_PIECES, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Every document's ids, with the end id, packed into sequences of at most `window` ids.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    `slack` is the padding that a combination may leave. Null and empty texts are the end id
    alone; a null doc_id stays null; repeated rows are packed as often as they come; an empty
    table gives no rows. Other columns are not read. The pieces (a few numbers for each
    window of tokens) are kept in the shared folder between cutting and packing.
    """
    pieces = kept(cut(docs, path, window, end_id, doc_id, text))
    groups = -(-pieces.count() // group_pieces) or 1
    return pack(pieces, groups, window, slack)
