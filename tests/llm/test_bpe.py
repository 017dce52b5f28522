"""The prefix tables and longest match against the public encoder and plain merging."""

import random

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from evistrata.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def public():
    pairs = bpe.byte_pairs()
    return tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=pairs.ranks, special_tokens={})


def merged(piece):
    pairs = bpe.byte_pairs()
    return [pairs.ranks[p] for p in pairs.merged(piece)]


def test_supplied_texts(public, data):
    for name, column in (("documents", "text"), ("chunks", "text")):
        for text in pd.read_parquet(f"{data}/{name}.parquet")[column].dropna():
            want = public.encode_ordinary(text)
            assert bpe.encoder().ids(text) == want
            assert bpe.counter().count(text) == len(want)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    pairs = bpe.byte_pairs()
    public = tiktoken.Encoding("own", pat_str=bpe.WORDS, mergeable_ranks=pairs.ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    want = public.encode_ordinary(text)
    assert bpe.encoder().ids(text) == want
    assert bpe.counter().count(text) == len(want)
    assert "".join(bpe.words(text)) == text


def test_special_and_missing():
    assert bpe.encoder().ids(None) == bpe.encoder().ids("") == [] and bpe.counter().count(None) == 0
    assert 50256 not in bpe.encoder().ids("<|endoftext|>")


def test_fits_means_that_the_encoding_of_both_is_both():
    r, pairs = random.Random(1), bpe.byte_pairs()
    for _ in range(1500):
        a, b = r.randrange(50_256), r.randrange(50_256)
        assert pairs.fits(a, b) == (merged(pairs.bytes_of[a] + pairs.bytes_of[b]) == [a, b])


def test_appends_and_edits():
    r = random.Random(2)
    alphabets = [b"abcde aaaa", b"the international ", bytes(range(256))]
    for _ in range(150):
        draw = lambda n: bytes(r.choice(r.choice(alphabets)) for _ in range(r.randrange(n)))
        table = bpe.PrefixTable(draw(40))
        table.append(draw(6))
        assert table.ids() == merged(table.piece)
        start = r.randrange(len(table.piece) + 1)
        end = r.randrange(start, len(table.piece) + 1)
        table.edit(start, end, draw(8))
        assert table.ids() == merged(table.piece)
    long = (b"internationalizationandmisrepresentation" * 40)
    table = bpe.PrefixTable(long)
    table.edit(300, 305, b"XYZ")
    assert table.ids() == merged(table.piece)


def test_longest_match_is_greedy():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abcd": 257, b"bcd": 258, b"cde": 259}
    trie = bpe.LongestMatch(ranks)

    def greedy(piece):
        out, at = [], 0
        while at < len(piece):
            size = next(n for n in range(min(4, len(piece) - at), 0, -1) if piece[at : at + n] in ranks)
            out.append(ranks[piece[at : at + size]])
            at += size
        return out

    r = random.Random(3)
    for _ in range(500):
        piece = bytes(r.choice(b"abcde") for _ in range(r.randrange(15)))
        assert trie.tokens(piece) == greedy(piece)
    assert bpe.longest_match().tokens(b"internationalization") != []
