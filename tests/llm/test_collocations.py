"""Collocations against counting by hand; perfect hashes, exact arithmetic, small bundles and tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import collocations as C


def by_hand(docs, fewest=30, top=2000, longest=4):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1))
    found = {k: a for k, a in f.items() if a >= fewest and len(k[1]) > 1}
    around = Counter()
    for (lang, p), a in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                around[lang, p[i : i + n]] = max(around[lang, p[i : i + n]], a)
    rows = {}
    for (lang, p), a in found.items():
        if 100 * around[lang, p] < 80 * a:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, x, y, total[lang], -s) for lang, own in rows.items() for i, (s, a, p, x, y) in enumerate(sorted(own)[:top]))


def found(docs, **how):
    return sorted(map(tuple, C.collocations(docs, **how).collect()))


def random_docs(seed, count=200):
    rng = random.Random(seed)
    words = ["a", "B", "é", "ß", "x-y", "日", "’", "long" * 20, *"cdefgh"]
    fixed = ["a b c d", "d c b", "é ß 日", "x-y a"]
    docs = []
    for i in range(count):
        text = "".join(rng.choice([rng.choice(words), rng.choice(fixed)]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "\xa0", "! "]) for _ in range(30))
        docs.append((text, rng.choice(["en", "de", None, "und", ""])))
    return docs


def table(make, docs, **how):
    return make([(i, text, lang, None) for i, (text, lang) in enumerate(docs)], **how)


@pytest.mark.parametrize("fewest", [2, 30, 300])
def test_by_hand(make, fewest):
    docs = random_docs(fewest)
    assert found(table(make, docs), fewest=fewest) == by_hand(docs, fewest)


@pytest.mark.parametrize("how", [{"bucket_bits": 6}, {"bucket_bits": 26, "bundle": 20}, {"slots": 50, "shard": 16}, {"bucket_bits": 25, "bundle": 1, "slots": 1, "shard": 40}, {"top": 7}, {"longest": 2}, {"longest": 3}])
def test_small_bounds(make, how):
    """Crowded buckets, several bundles of ranges and several tables give the same rows."""
    docs = random_docs(1, 60)
    assert found(table(make, docs), fewest=5, **how) == by_hand(docs, 5, how.get("top", 2000), how.get("longest", 4))


@pytest.mark.parametrize("size", [0, 1, 2, 70, 5000])
def test_perfect_hash(size):
    rng = np.random.default_rng(size)
    keys = rng.integers(0, 1 << 64, (size, 2), dtype=np.uint64)
    keys[: size // 2, 0] = 7  # halves that clash
    built = [(s, *C.perfect_hash(keys[keys[:, 1] % np.uint64(3) == s])) for s in range(3)]
    slots = C.SlotTable(3, built)
    assert len(slots) == size and sorted(slots.slots(keys[:, 0], keys[:, 1]).tolist()) == list(range(size))
    strange = rng.integers(0, 1 << 64, (1000, 2), dtype=np.uint64)
    assert (slots.slots(strange[:, 0], strange[:, 1]) == -1).all() and (slots.slots(keys[:, 0], keys[:, 1] + np.uint64(3)) == -1).all()


def test_equal_keys_raise():
    with pytest.raises(ValueError, match="128-bit"):
        C.perfect_hash(np.ones((2, 2), dtype=np.uint64))


def test_keys_of_phrases():
    langs, texts = [b"en", b"de", b""], [b"A b, c d e", None, b"b c"]
    found = C.Phrases(texts, langs, C._Numbers())
    wanted = {(lang, n, p) for lang, ps in ((b"en", [b"a b", b"c d e"]), (b"", [b"b c"])) for p in ps for w in [p.split()] for n in (1, 2, 3, 4) for p in [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]}
    got = set()
    for n in (1, 2, 3, 4):
        keys, places = found.keys(n), np.flatnonzero(found.whole(n))
        seconds = dict(zip(places.tolist(), found.second_halves(n, places).tolist(), strict=True))
        for at in places.tolist():
            lang, phrase = found.langs[found.lang[at]], found.spelled(at, n).encode()
            got.add((lang, n, phrase))
            assert C.phrase_key(lang, phrase) == (int(keys[at]), seconds[at])
    assert got == wanted


def test_exact_scores(spark, monkeypatch):
    """Counts whose products pass 64 bits, and a cut that is tied."""
    big = 9_000_000_000_000_000_000
    rows = [("x", "a b", big, big, [(1, big, big)]), ("x", "a b c", 4 * 10**18, big, [(1, big, 10), (2, big, 10)]), ("x", "p q", 10**13 + 1, big, [(1, 10**13 + 2, 10**13 + 1)])]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, n long, cuts array<struct<k: int, l: long, r: long>>")
    monkeypatch.setattr(C, "phrase_counts", lambda docs, **how: frame)
    got = {r.phrase: r for r in C.collocations(frame).collect()}
    assert got["a b"].score == 1000000 and got["a b c"].score == 2000000 * 4 * 10**18 // (big + 10) and got["p q"].score == 2000000 * (10**13 + 1) // (2 * 10**13 + 3)


def test_odd_rows(make):
    """Null and empty texts, null languages, repeated rows, a very long text, clashing names, empty tables and rare phrases."""
    docs = [(None, "en"), ("", None), (" ,.;\n", "en"), ("one two. " * 40, None), ("one two. " * 40, None), ("ein wort und " * 40000, "de"), ("x" * 100000, "fr")]
    assert found(table(make, docs, extra=("phrase", "a", "n", "rank"))) == by_hand(docs)
    assert found(make([])) == found(table(make, [("a b c", "en")])) == []
    assert C.collocations(make([])).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_candidates_are_sent_once_by_a_task(make, monkeypatch):
    """Far more candidates than a lot has: a task sends each of them once, however often its lots repeat them."""
    rows = []
    scanned = C._scanned
    monkeypatch.setattr(C, "_scanned", lambda *a: rows.append(scanned(*a)) or rows[-1])
    docs = table(make, [(" ".join(f"w{i}" for i in range(90_000)), "en")] * 4).repartition(1)
    heavy = C.cut_lineage(C.heavy_buckets(docs, 30, fewest=4))
    found = C.candidate_phrases(docs, heavy, C._heavy_map(heavy, 30, heavy.agg({"n": "sum"}).first()[0]))
    assert found.count() == rows[-1].count() == 4 * 90_000 - 6 + 1


def test_hashes_of_words():
    """Words of all sizes, some longer than what is hashed side by side, as one by one; near ones differ."""
    rng = random.Random(3)
    words = [bytes(rng.choice(b"xyz\x00\xc3") for _ in range(n)) for n in range(1, 200)] + [b"\x00" * n for n in range(1, 80)]
    found = C.Phrases([b" ".join(words)], [b"en"], C._Numbers())
    got = list(zip(found.first.tolist(), found.second.tolist(), strict=True))
    assert got == [C._halves(w) for w in words]
    assert len({h for h, _ in got}) == len({h for _, h in got}) == len(set(words))


def test_sent_keys():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64) >> np.uint64(3) << np.uint64(3))  # places that clash
    sent = C._Sent(6000)
    sent.add(keys[:2000])
    sent.add(keys[2000:4000])
    assert sent.has(np.repeat(keys, 2)).tolist() == [True] * 8000 + [False] * (2 * len(keys) - 8000)
    assert not sent.has(np.zeros(2, dtype=np.uint64)).any()
    sent.add(np.zeros(1, dtype=np.uint64))
    sent.add(np.arange(1, 2001, dtype=np.uint64))
    assert sent.has(np.arange(1, 2001, dtype=np.uint64)).all() and not sent.has(keys[:4000]).any()
