"""Byte-level BPE, token records and packing against the tokenizer libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from stridelog.llm.best_fit_packing import best_fit_packing, plan_best_fit
from stridelog.llm.byte_bpe import ByteBPE, Transducer, Utf8Stream, encode_and_decode, load_ranks
from stridelog.llm.common import shared_folder
from stridelog.llm.token_records import (
    checked,
    framed,
    read_index,
    read_record,
    token_records,
    write_token_records,
)
from stridelog.llm.vocabulary import WordEncoder

from .conftest import awkward, dicts

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = " \t\n\u0000abcIthe ingéİΣςσ,.!?;:'$»“😀中9 ́\x1c\x85\xa0sStm0"


@pytest.fixture(scope="module")
def library():
    ranks = load_ranks(BYTES)
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@pytest.fixture(scope="module")
def words():
    tokenizer = Tokenizer.from_file(WORDS)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def strings(n: int, seed: int = 0):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40)))


def test_transducer_equals_the_library(library):
    bpe = ByteBPE(BYTES, public_tokenizers.PATTERN)
    for text in [*strings(3000), "a" * 5000, "ab" * 3000, *(t for _, t in awkward())]:
        assert bpe.encode(text).tolist() == library.encode_ordinary(text or "")


def test_transducer_forgets_states_and_stays_right(library):
    small = Transducer(load_ranks(BYTES), max_states=50)
    for text in strings(500, 1):
        for piece in library._pat_str and [text.encode()]:
            if piece:
                assert small.encode(piece) == library._encode_single_piece(piece)


def test_utf8_stream_at_every_cut():
    data = "aé中😀z".encode()
    for i in range(len(data) + 1):
        for j in range(i, len(data) + 1):
            stream = Utf8Stream()
            parts = [stream.feed(data[:i]), stream.feed(data[i:j]), stream.feed(data[j:])]
            assert "".join(parts) + stream.close() == "aé中😀z"
    stream = Utf8Stream()
    assert stream.feed(b"a\xff\xe4") + stream.close() == "a��"


def test_decoding_in_chunks_that_cut_characters():
    bpe = ByteBPE(BYTES, public_tokenizers.PATTERN)
    text = "中文字😀é" * 20
    ids = bpe.encode(text)
    assert "".join(bpe.decode(ids[i : i + 1] for i in range(len(ids)))) == text


def test_bpe_rows(docs, empty, library):
    got = sorted(
        (str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])
        for r in dicts(encode_and_decode(docs, BYTES, public_tokenizers.PATTERN))
    )
    expected = []
    for i, t in awkward():
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        sha = hashlib.sha256
        expected.append((str(i), len(ids), sha(ids.tobytes()).hexdigest(), sha((t or "").encode()).hexdigest()))
    assert got == sorted(expected)
    assert encode_and_decode(empty, BYTES, public_tokenizers.PATTERN).count() == 0


def test_word_encoder_equals_the_library(words):
    small = WordEncoder(WORDS, memo_bytes=4_000)
    for text in [*strings(3000, 2), *(t for _, t in awkward())]:
        assert small.encode((text or "").encode()).tolist() == words(text)


def test_records_read_back(docs, empty, words):
    rows = dicts(token_records(docs, WORDS, 2))
    expected = [
        (i, len(ids := [*words(t), 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in awkward()
    ]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=key) == sorted(
        expected, key=key
    )
    rows.sort(key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in rows]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert token_records(empty, WORDS, 2).count() == 0


def test_records_by_index_in_any_order(llm, docs, words):
    manifest = write_token_records(docs, WORDS, 2, shared_folder(llm)).collect()
    found = {}
    for shard in manifest:
        entries = read_index(shard.path)
        for entry in entries[::-1]:
            if entry["known"]:
                found[int(entry["doc_id"])] = read_record(shard.path, entry, shard.width).tolist()
    assert found == {i: [*words(t), 2] for i, t in awkward() if i is not None}


def test_damage_is_noticed():
    record = framed(b"payload")
    assert checked(record) == b"payload"
    for i in range(len(record)):
        with pytest.raises(ValueError):
            checked(record[:i] + bytes([record[i] ^ 1]) + record[i + 1 :])
    with pytest.raises(ValueError):
        checked(record[:-1])


def slots(histogram, size):
    bins = {}
    ranks = {n: [] for n in histogram}
    for length, rank, n, first, offset in plan_best_fit(histogram, size):
        for k in range(n):
            bins.setdefault(first + k, []).append((offset, length))
            ranks[length].append(rank + k)
    assert {n: list(range(c)) for n, c in histogram.items()} == {n: sorted(r) for n, r in ranks.items()}
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def best_fit_decreasing(histogram, size):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            room = min(fits) if fits else size
            if fits:
                rooms.remove(room)
            rooms.append(room - length)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(200):
        size = rng.choice([1, 7, 16, 64])
        histogram = {rng.randint(1, size): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        assert slots(histogram, size) == best_fit_decreasing(histogram, size)
    assert slots({}, 8) == 0


def test_plan_size_does_not_grow_with_the_counts():
    rng = random.Random(5)
    histogram = {n: rng.randint(1, 50) for n in range(1, 513)}
    small = len(plan_best_fit(histogram, 512))
    large = len(plan_best_fit({n: 10**9 * c for n, c in histogram.items()}, 512))
    assert large < 4 * small + 4 * 512


def test_packing_equals_brute_force(docs, empty, words):
    size = 64
    got = dicts(best_fit_packing(docs, WORDS, 1, size))
    expected = []
    for i, t in awkward():
        ids = np.array([*words(t), 1], "<u4")
        expected += [
            (str(i), p, s, len(part := ids[s : s + size]), zlib.crc32(part.tobytes()))
            for p, s in enumerate(range(0, len(ids), size))
        ]
    assert sorted(
        (str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got
    ) == sorted(expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    assert best_fit_packing(empty, WORDS, 1).count() == 0


def test_words_encode_as_the_library_does_with_its_own_tokens():
    from tokenizers import Tokenizer

    from stridelog.llm.vocabulary import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words = Tokenizer.from_file(path), WordEncoder(path, memo_bytes=2_000)
    rng = random.Random(4)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "a", "É", "end.", "\n", "İ", "<"]
    for _ in range(500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode(text.encode()).tolist() == expected, text
    assert words._held < 4_000


def test_new_words_of_a_text_are_encoded_in_one_call(words):
    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, 0

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder = WordEncoder(WORDS)
    encoder._tokenizer = counting = Counting(encoder._tokenizer)
    text = "some, words; that vary: \u00e9t\u00e9 zwq9x \u00a0 a\u00a0b $% \u4e2d\u6587!"
    assert encoder.encode(text.encode()).tolist() == words(text)
    assert counting.texts == 1
    for text in ("\x01", "p \x01 q", "r\x01s t\x01 \x01u", "\x01\x01 v"):  # what stands between words
        assert encoder.encode(text.encode()).tolist() == words(text), text
