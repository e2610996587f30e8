"""Spelling variants against comparing all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import spelling as S


def words_by_hand(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}


def near_by_hand(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(docs):
    words, rows = words_by_hand(docs), {}
    for w, n in words.items():
        near = [(-words[v], v) for v in words if near_by_hand(w, v)]
        least = min(near, default=None)
        form = least[1] if least and -least[0] >= 2 * n else None
        rows[w] = [form, w, n, len(near), words[form] if form else None]
    for w, row in rows.items():
        while rows[row[1]][0]:
            row[1] = rows[row[1]][0]
    return sorted((w, *r) for w, r in rows.items())


def found(docs, **how):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in S.spelling_variants(docs, **how).collect())


def random_docs(seed, letters, count=60):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(3, 8))) for _ in range(40)]
    return [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(40)], k=80)) + rng.choice(["", " Étude÷x", " ab’cdefg"])) for i in range(count)]


@pytest.mark.parametrize("letters", ["ab", "abcD", "aéÀ"])
def test_by_hand(spark, make, letters):
    docs = random_docs(letters, letters)
    assert found(make(docs)) == variants_by_hand(docs)


@pytest.mark.parametrize("bits", [15, 28])
def test_bitmap_too_small(spark, make, bits, monkeypatch):
    """A bitmap with all bits set lets every string through; the join tells words from others."""
    docs = random_docs(9, "abcd")
    if bits == 15:
        monkeypatch.setattr(S, "_bitmap", lambda vocabulary, bits: np.full(1 << bits >> 3, 255, dtype=np.uint8))
    monkeypatch.setattr(S, "HASHED", 100)  # many short steps
    assert found(make(docs), bitmap_bits=bits) == variants_by_hand(docs)


def neighbourhood(word, alphabet):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in alphabet} | {a + c + b[1:] for a, b in cuts if b for c in alphabet} - {word}


def test_neighbourhood_is_whole_and_distinct():
    alphabet = "abé"
    codes = np.array([*map(ord, alphabet)], dtype=np.uint64)
    for word in ["a", "aa", "abé", "aabba", "b" * 70]:
        spelled, hashes = [], []
        for kind, at, found_hashes, counts in S.neighbour_hashes(S._codes([word]), codes):
            hits = np.nonzero(counts)
            spelled += [x for _, x in S._spelled([word], kind, at, hits, alphabet)]
            hashes += found_hashes[hits].tolist()
        assert len(spelled) == len(set(spelled)) and set(spelled) == neighbourhood(word, alphabet)
        assert all(S.word_hashes([x])[1].tolist() == [h] for x, h in zip(spelled, hashes, strict=True) if x)


def test_chain_of_forms(spark, make):
    """Each form is the variant of a more frequent one, so the root is many steps away."""
    words = ["q" * k + "x" * (12 - k) for k in range(9)]
    docs = make([(None, " ".join(w for i, w in enumerate(words) for _ in range(3 * 2**i)))])
    rows = found(docs, typo_every=1 << 40)
    assert {r[2] for r in rows} == {words[-1]} and len(rows) == 9


def test_odd_rows(spark, make):
    long_word = "ab" * 20000
    docs = [(1, None), (2, ""), (3, "1 2 , ’"), (4, "Hello hello HELLO"), (4, "hello"), (None, "hallo hallo hallo"), (5, f"{long_word} {long_word} {long_word}c {long_word} {long_word}c {long_word}c"), (6, "××××× " * 4)]
    rows = {r[0]: r for r in found(make(docs, extra=("word", "n", "form")), typo_every=1 << 40)}
    assert rows["hello"][3] == 4 and rows["hallo"][1:] == (None, "hallo", 3, 1, None) and rows[long_word][4] == 1 and "×" * 5 in rows
    assert found(make([])) == found(make([(1, "a b c")])) == []
    assert S.spelling_variants(make([])).columns == ["word", "form", "root", "n", "n_near", "form_n"]
