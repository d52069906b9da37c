from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_tools import ODD, frame
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe as B
from tidemark.llm import packing as P
from tidemark.llm import pretokens as T
from tidemark.llm.texthash import word_hashes

PATTERN = regex.compile(public_tokenizers.PATTERN)
ALPHABET = "abst'rel vmd  \n\t19!?é漢\u00a0²LlS\"_\U0001f600"


def split(text):
    data = text.encode()
    begin, end, _ = T.spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return [data[a:b].decode() for a, b in zip(begin.tolist(), end.tolist())]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=16))
def test_pretokens_equal_the_pattern(text):
    assert split(text) == PATTERN.findall(text)


def thue_morse(n):
    """A word and its complement, whose polynomial hashes modulo 2**64 are equal whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_word_hash_tells_odd_pairs_apart():
    rng = np.random.default_rng(1)
    texts = [*thue_morse(1024), *thue_morse(4096), "a" * 8, "a" * 9, "a" * 16, "a\0", "a", "\0", "ab" * 8, "ba" * 8]
    texts += ["".join(map(chr, rng.integers(97, 99, 24))) for _ in range(2000)]
    texts = sorted(set(texts))
    hashes = np.concatenate([h for h, _ in word_hashes(pa.array(texts), lower=False)])
    assert len(set(hashes.tolist())) == len(texts)
    alone = [next(word_hashes(pa.array([t]), lower=False))[0][0] for t in texts[:200]]
    assert hashes[:200].tolist() == alone
    assert [h.tolist() for h, _ in word_hashes(pa.array(["ABC É"]))] == [h.tolist() for h, _ in word_hashes(pa.array(["abc É"]))]


def test_memo_compares_bytes(monkeypatch, library):
    """With a hash that tells nothing apart, and a small memo, the ids are still right."""
    monkeypatch.setattr(T, "hash_blocks", lambda blocks, per_word, size: np.asarray(size % 3, np.uint64))
    transducer = B.Transducer(B.read_ranks(B.multi_vocabulary()))
    memo = T.Memo(lambda pieces: [transducer.encode(p) for p in pieces], most=40)
    texts = ["the cat sat on the mat and the dog", None, "", "x" * 30 + " it's 12 \n\n  " + "é" * 20, *thue_morse(1024), *thue_morse(64)] * 3
    for most in (1 << 18, 50):
        got = [x.tolist() for x in memo.encode_column(pa.array(texts), most)]
        assert got == [library.encode_ordinary(t or "") for t in texts]


def test_documents_do_not_run_together():
    texts = ["a ", " b", "", "'s", "x'", "ll"]
    data = "".join(texts).encode()
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    _, _, per_doc = T.spans(np.frombuffer(data, np.uint8), off)
    assert per_doc.tolist() == [len(PATTERN.findall(t)) for t in texts]


@pytest.fixture(scope="module")
def ranks():
    return B.read_ranks(B.multi_vocabulary())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def transducer(ranks):
    return B.Transducer(ranks)


@settings(max_examples=200, deadline=None)
@given(data=st.binary(min_size=1, max_size=14))
def test_transducer_on_bytes(ranks, transducer, data):
    assert transducer.encode(data) == [ranks[p] for p in B.merge_naively(ranks, data)]


def test_transducer_on_words(ranks, library):
    dice = random.Random(1)
    small = B.Transducer(ranks, most_states=50)  # starts anew again and again
    for _ in range(400):
        word = "".join(dice.choice("aeinorstuhdlcméü漢ing") for _ in range(dice.randint(1, 20))).encode()
        assert small.encode(word) == library._encode_single_piece(word)


def test_states_are_bounded_inside_a_text(ranks, library):
    small = B.Transducer(ranks, most_states=50)
    data = "".join(random.Random(4).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    assert small.encode(data.encode()) == library.encode_ordinary(data)
    assert len(small.states) <= 51


def test_encoding_whole_texts(library):
    texts = [r[1] for r in ODD] + ["<|endoftext|> x", "a" * 3000]
    memo = B._tools(B.multi_vocabulary())[0]
    got = [x.tolist() for x in memo.encode_column(pa.array(texts))]
    assert got == [library.encode_ordinary(t or "") for t in texts]
    tiny = T.Memo(memo.encode, most=3)
    assert [x.tolist() for x in tiny.encode_column(pa.array(texts), most=20)] == got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0, 0xF4, 0x90]), max_size=14), st.randoms())
def test_streaming_decoder(data, dice):
    decoder, out, at = B.Decoder([bytes([x]) for x in range(256)]), "", 0
    while at < len(data):
        n = dice.randint(1, 4)
        out += decoder.feed(data[at : at + n])
        at += n
    assert out + decoder.close() == bytes(data).decode("utf-8", "replace")


def test_round_trip(spark, library):
    docs = frame(spark, ODD)
    got = sorted(map(tuple, B.round_trip(docs).collect()), key=repr)
    want = []
    for i, text, *_ in ODD:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = B.decode(B.encode(docs))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in back.collect()) == sorted((i or -1, t or "") for i, t, *_ in ODD)
    assert B.round_trip(frame(spark, [])).count() == 0


# --- packing ---


def test_cuts():
    assert P.cuts(1, 8) == [(0, 1)] and P.cuts(8, 8) == [(0, 8)] and P.cuts(9, 8) == [(0, 1), (1, 8)]
    assert P.cuts(24, 8) == [(0, 8), (8, 8), (16, 8)] and P.cuts(20, 8) == [(0, 4), (4, 8), (12, 8)]


def least_bins(sizes, capacity):
    """By search over all packings."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(at, room):
        nonlocal best
        if len(room) >= best:
            return
        if at == len(sizes):
            best = len(room)
            return
        for r in sorted(set(room)):
            if r >= sizes[at]:
                k = room.index(r)
                go(at + 1, [*room[:k], r - sizes[at], *room[k + 1 :]])
        go(at + 1, [*room, capacity - sizes[at]])

    go(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_and_best_fit(sizes):
    array = np.array(sizes)
    bins, offsets, left = P.best_fit_decreasing(array, 20)
    least = least_bins(sizes, 20)
    assert P.lower_bound(array, 20) <= least <= len(left) <= least * 11 / 9 + 1
    for b in range(len(left)):
        own = sorted((int(o), int(s)) for o, s, k in zip(offsets, sizes, bins) if k == b)
        assert [o for o, _ in own] == [sum(s for _, s in own[:i]) for i in range(len(own))] and sum(s for _, s in own) == 20 - left[b]


def test_bound_beats_the_sum():
    assert P.lower_bound(np.array([11] * 6), 20) == 6 and P.lower_bound(np.array([7] * 6), 20) == 3 and P.lower_bound(np.array([], int)) == 0


def check_packed(rows, capacity):
    by: dict = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    return len(by)


def test_packing_documents(spark):
    named = ["<|endoftext|> is a token", "so is\n<|endoftext|>", "a<|endoftext|><|endoftext|> b " * 900, "<|endoftext| isn't"]
    rows = [*ODD, *[(30 + i, t, "en", "s", 0) for i, t in enumerate(named)]]
    got = P.best_fit_packing(frame(spark, rows).withColumnRenamed("n_chars", "length"), ids=True).collect()
    check_packed(got, P.CAPACITY)
    tokenizer = Tokenizer.from_file(P.vocabulary())
    want = []
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, (at, n) in enumerate(P.cuts(len(ids), P.CAPACITY)):
            part = np.array(ids[at : at + n], "<u4")
            want.append((i, k, at, n, zlib.crc32(part.tobytes()), part.tolist()))
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert P.best_fit_packing(frame(spark, [])).count() == 0


def test_partitions_exchange(spark):
    dice = random.Random(9)
    sizes = [dice.randint(500, 1500) for _ in range(600)]
    rows = spark.createDataFrame([(i, 0, 0, n, i * 7, "x") for i, n in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long, offset string")
    alone = P.pack(rows, part=50, rounds=1)
    got = P.pack(rows, part=50).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(600))
    whole = len(P.best_fit_decreasing(np.array(sizes))[2])
    n = check_packed(got, P.CAPACITY)
    assert n <= check_packed(alone.collect(), P.CAPACITY) and P.lower_bound(np.array(sizes)) <= n <= whole * 1.06


def test_exchange_goes_on_while_it_gains(spark):
    dice = random.Random(12)
    sizes = [dice.randint(200, 1100) for _ in range(1500)]
    rows = spark.createDataFrame([(i, 0, 0, n, i * 7) for i, n in enumerate(sizes)], P.PIECES)
    six = check_packed(P.pack(rows, part=8, rounds=6).collect(), P.CAPACITY)
    assert P.lower_bound(np.array(sizes)) <= check_packed(P.pack(rows, part=8).collect(), P.CAPACITY) < six
