import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from gleanwork.llm import bpe_tree, packing, segments, token_counts
from gleanwork.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
COUNTED = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def samples():
    draw = random.Random(5)
    alphabet = "aab  \n\t.,'sé\x1c\x85\xa01中<|é́İΣſ"
    made = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 60))) for _ in range(600)]
    return ["", " ", "a" * 4001, "ab" * 999, "<|endoftext|> x<|endoftext|>", "don't I'LL", "a  b \n\n c ", "日本語" * 99, "ΣΑΣ.", *made]


@pytest.fixture(scope="module")
def library():
    ranks = bpe_tree.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_encodes_as_the_library(samples, library):
    bpe, packed = bpe_tree._coder(RANKS, public_tokenizers.PATTERN)
    for text in samples:
        ids = np.frombuffer(b"".join(map(packed.__getitem__, segments.SEGMENTS(text))), "<u4").tolist()
        assert ids == library.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_joins_any_cut(library):
    bpe, _ = bpe_tree._coder(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(2)
    for _ in range(300):
        piece = bytes(draw.choice(b"aabbthein ") for _ in range(draw.randint(2, 40)))
        at = draw.randint(1, len(piece) - 1)
        whole = tuple(library._core_bpe.encode_single_piece(piece))
        assert bpe.join(bpe.encode(piece[:at]), bpe.encode(piece[at:])) == whole == bpe.merge(piece)


def test_unknown_ids_decode_to_nothing():
    assert bpe_tree._coder(RANKS, public_tokenizers.PATTERN)[0].decode([1, 10**6]) is None


def test_heap_counts_as_the_library(samples):
    tokenizer = Tokenizer.from_file(COUNTED)
    of = token_counts._counter(COUNTED)
    assert [of(t) for t in samples] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in samples]


def test_refuses_other_tokenizers():
    with pytest.raises(ValueError):
        token_counts.read_model(WORDS)


def test_word_ids_are_the_librarys(samples):
    tokenizer = Tokenizer.from_file(WORDS)
    want = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in [*samples, None, ""]]
    encode = packing._encoder(WORDS)
    for kind in (pa.string(), pa.large_string()):
        texts = pa.array(["left out", *samples, None, ""], kind)[1:]
        ids, bounds = encode(texts, 1)
        assert [ids[i:j].tolist() for i, j in zip(bounds, bounds[1:], strict=False)] == want
    ids, bounds = encode(pa.array([None, "", " "], pa.string()), 1)
    assert ids.tolist() == [1, 1, 1] and bounds.tolist() == [0, 1, 2, 3]


def test_memo_stays_small():
    memo = segments.Memo(len, 10)
    for _ in range(2):
        for word in map(str, range(100)):
            assert memo[word] == len(word)
    assert len(memo) <= 5 and len(memo.old) <= 5


def test_odd_rows(odd):
    for frame in (odd, odd.limit(0)):
        coded = bpe_tree.round_trip(frame, RANKS, public_tokenizers.PATTERN).collect()
        counted = token_counts.with_counts(frame, COUNTED, 512).collect()
        assert len(coded) == len(counted) == frame.count()
        for row, count in zip(coded, counted, strict=True):
            assert bytes(row.decoded).decode() == (row.text or "")
            assert count.n_bytes == len((count.text or "").encode())
            assert (count.n_tokens == 0) == (not count.text)
            assert count.over_limit == (count.n_tokens > 512)


def test_queries(spark, texts, library):
    tokenizer = Tokenizer.from_file(COUNTED)
    for row in QUERIES["op1_bpe_round_trip"](spark, SF).collect():
        ids = np.array(library.encode_ordinary(texts[row.doc_id]), "<u4").tobytes()
        assert (row.n_tokens, row.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
    for row in QUERIES["op2_token_counts"](spark, SF).collect():
        assert row.n_tokens == len(tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids)


def check_packing(rows, texts):
    import zlib

    tokenizer = Tokenizer.from_file(WORDS)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert {*pieces} == {*texts}
    for doc, found in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    waste = total = 0
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += 2048
        waste += 0 if at & (at - 1) == 0 else 2048 - at
    return waste / total


def test_packing(spark, texts):
    assert check_packing(QUERIES["op10_packing"](spark, SF).collect(), texts) < 0.03


def test_packing_of_odd_rows(odd):
    rows = packing.pack_documents(odd, WORDS, group_pieces=2).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2, 3)) == 3
    assert sorted(r.doc_id for r in rows if r.start == 0 and r.doc_id is not None) == [0, 1, 2, 3, 4, 5, 5, 6, 7]
    assert packing.pack_documents(odd.limit(0), WORDS).collect() == []


def test_least_squares_finds_an_exact_mix():
    columns, weights = np.array([[0, 1], [1, 1]]), np.array([[1.0, 1.0], [1.0, 0.0]])
    found = packing.nonnegative_least_squares(columns, weights, np.array([10, 14]), 400)
    assert np.allclose(found, [10, 4], atol=0.1)


def test_plan_holds_every_piece_once():
    lengths = np.array([2048, 1024, 1024, 700, 700, 648, 3, 2047, 1])
    bins = packing.plan(lengths, 2048, 8)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 2048 for b in bins) and len(bins) == 5
