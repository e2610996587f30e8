"""Word BPE against the library and against merging by hand."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm import word_bpe as W

TOKENS = ["İ", "ẞ", "a", "'", "'S", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "é", "́", "　", "\x85", "\x1c", "½", "²", "一", "١", "<|", "|>", "ΑΣ", "퟿", "\U0001f642"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(W.TOKENIZER_PATH)


@pytest.fixture(scope="module")
def encoder():
    return W.WordEncoder(W.load_vocabulary())


def assert_library(encoder, library, texts):
    for text, (ids, decoded) in zip(texts, encoder.encode(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == wanted, text
        assert decoded.decode() == library.decode(wanted, skip_special_tokens=False), text


@pytest.mark.parametrize("top", [0x80, 0x250, 0x3000, 0x110000])
def test_random_strings(encoder, library, top):
    rng = random.Random(top)
    pool = [chr(c) for c in range(top) if not 0xD800 <= c < 0xE000]
    assert_library(encoder, library, ["".join(rng.choices(pool, k=rng.choice([5, 30, 200]))) for _ in range(500)])


def test_odd_tokens_and_long_words(encoder, library):
    rng = random.Random(5)
    texts = ["".join(rng.choices(TOKENS, k=20)) for _ in range(800)]
    assert_library(encoder, library, [*texts, "", " ", "a" * 5000, "ab" * 3000, "the" * 2000, "é" * 700, "!" * 3000, *("x" * n for n in range(1, 140)), *("in" * n for n in range(1, 70))])


def merged_by_hand(symbols, vocabulary):
    """A fresh search for the leftmost pair of lowest rank at every step."""
    symbols = list(symbols)
    while True:
        pairs = [(vocabulary.ranks[a << 16 | b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a << 16 | b in vocabulary.ranks]
        if not pairs:
            return symbols
        rank, i = min(pairs)
        symbols[i : i + 2] = [vocabulary.made[rank]]


def test_trees_by_hand(encoder):
    """Single trees and trees side by side against the definition, on words of every length up to the widest tree."""
    own, rng = encoder.vocabulary, random.Random(3)
    for width in W.WIDTHS:
        words = [bytes(rng.choices(b"aaeinorst", k=rng.randint(1, width - 2))) for _ in range(300)]
        rows = np.full((len(words), width), W._GONE, dtype=np.int64)
        symbols = [[*(own.inside[b] for b in w[:-1]), own.last[w[-1]]] for w in words]
        for row, s in zip(rows, symbols, strict=True):
            row[1 : len(s) + 1] = s
        for row, s in zip(W.merge_side_by_side(rows, encoder.pairs).tolist(), symbols, strict=True):
            wanted = merged_by_hand(s, own)
            assert [x for x in row if x != W._GONE] == wanted == W.merge_word(list(s), own.ranks, own.made)


def test_forgetting(library, monkeypatch):
    monkeypatch.setattr(W, "REMEMBERED", 5)
    encoder = W.WordEncoder(W.load_vocabulary())
    for k in range(5):
        assert_library(encoder, library, [f"one two three{k} four five six seven", "eight nine"])


def test_whole_table(spark, small, texts, library):
    found = {r.doc_id: r for r in W.word_bpe_digest(small).collect()}
    assert len(found) == len(texts)
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = found[doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_round_trip_and_odd_rows(spark, make, library):
    """Null and empty texts, null and repeated ids, a very long text, clashing names and an empty table."""
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello<|endoftext|>World"), (4, "Hello<|endoftext|>World"), (None, "x"), (5, "ein langer text " * 30000)]
    docs = make(rows, extra=("ids", "n_tokens"))
    encoded = W.encode_words(docs)
    found = sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str)
    assert found == sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    decoded = {r.doc_id: r.text for r in W.decode_words(encoded).collect()}
    assert decoded[4] == "hello</w> <|endoftext|> world</w>" and decoded[1] == decoded[2] == decoded[3] == "" and len(decoded[5].split()) == 120000
    digests = {r.doc_id: r for r in W.word_bpe_digest(docs).collect()}
    assert digests[1][1:] == digests[2][1:] and digests[1].n_tokens == 0 and digests[5].n_tokens == 120000 and len(digests) == 6
    assert W.encode_words(make([], extra=("ids",))).count() == 0
    assert W.word_bpe_digest(make([])).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
