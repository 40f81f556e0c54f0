"""Byte-level BPE against the tiktoken library and the pattern itself."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from panelspark.llm import byte_pairs, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "'", " ", "  ", "\n", "a'r", "a're", "'s's", " 's", "\n's", "''ll", "x'", "'lL", "1's", " a", "a" * 3000, "'" * 400,
       " " * 999, "\u0085'm", "a  b", "\u001cb", "é x", "😀😀 ½"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.ranks(RANKS),
                             special_tokens={})


def odd_texts(n):
    r = random.Random(3)
    signs = "  \n\t'strevlmdSTa1²٣é中.,! \u0085\u001c​́😀"
    return ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(n)] + ODD


def test_words_are_those_of_the_pattern():
    texts = odd_texts(5000)
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text, got in zip(texts, byte_pairs.words(texts)):
        assert got == [m.group() for m in pattern.finditer(text)], text


def test_scan_is_the_automaton_step_by_step():
    maps, both, states, _ = byte_pairs._automaton()
    for n in (1, 63, 64, 65, 1000, 70_001):
        kind = np.random.default_rng(n).integers(0, 9, n)
        got = states[byte_pairs._scan(maps[kind], both, len(states)), byte_pairs.START]
        state = byte_pairs.START
        for k in range(n):
            assert got[k] == state
            state = states[maps[kind[k]], state]


def test_ids_and_offsets_equal_the_library(library):
    c = byte_pairs.codec(RANKS)
    texts = odd_texts(3000)
    for text, cut in zip(texts, byte_pairs.words(texts)):
        ids = c.ids(cut)
        assert ids.tolist() == library.encode_ordinary(text)
        assert c.decode(ids, c.offsets(ids)) == text.encode()
    with pytest.raises(ValueError, match="offsets"):
        c.decode(np.array([5, 6]), np.array([0, 7]))


def test_long_words_merge_alike():
    c = byte_pairs.codec(RANKS)
    r = random.Random(5)
    for n in (97, 200, 500):
        word = "".join(r.choice("abtheing") for _ in range(n)).encode()
        byte_pairs.LONG_MERGE, kept = 10**9, byte_pairs.LONG_MERGE
        try:
            plain = c.merge(word)
        finally:
            byte_pairs.LONG_MERGE = kept
        assert c._merge_long(word) == plain


def test_cache_of_two_halves(library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHE_UNITS", 7)
    c = byte_pairs.Codec(RANKS)
    text = " ".join(f"word{k % 11} aa{k % 3}" for k in range(200))
    assert c.ids(byte_pairs.words([text])[0]).tolist() == library.encode_ordinary(text)
    assert len(c) <= 7 and len(c.older) <= 7


def test_query_equals_library(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_byte_pairs"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got.n_tokens[i] == len(ids)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_of_odd_rows(spark):
    rows = [(1, "a b", 3), (1, "a b", 4), (None, None, 5), (2, "", 6), (3, "x " * 50_000, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    back = byte_pairs.decode(byte_pairs.encode(docs, RANKS), RANKS).collect()
    assert sorted((r[0] or 0, bytes(r[1]).decode()) for r in back) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert byte_pairs.encode(docs.limit(0), RANKS).count() == 0
    empty = byte_pairs.digests(docs.where("doc_id = 2"), RANKS).first()
    assert (empty.n_tokens, empty.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
