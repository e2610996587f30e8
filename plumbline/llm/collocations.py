"""Collocations: phrases of two to four words that belong together, counted in slots of a minimal perfect hash.

1. Nominate. Every phrase of one to four words falls by a hash into one of up to 2**42 buckets;
   tasks count their own buckets, which meet by ranges in a shuffle. A phrase with enough
   occurrences lies in a heavy bucket, and so does each of its parts.
2. Spell. Phrases that are in a heavy bucket with all their parts are the candidates: no phrase
   with enough occurrences is missing (Apriori), and few others come with them. A task sends each
   candidate once, as it remembers the keys that it has sent.
3. Number. Shards of candidates each get a minimal perfect hash: level by level, keys that fall
   alone into a place of a bit vector stay there, the others go on. A key's slot is the number of
   bits before its own. The 128-bit key that owns a slot is stored with it.
4. Count. Every task looks the phrases of its texts up, checks their keys against those stored,
   bincounts the slots into one numpy array and sends it on once; arrays are summed as a tree.
5. Cut. A candidate's count and those of the parts of each cut are read from the summed array by slot.

What one scan takes along is bounded: heavy buckets to spell by BUNDLE, slots to count by SLOTS. If
there are more, steps 2 and 4 scan the texts again for the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.columns import text_or_empty
from plumbline.llm.storage import bits_of, cut_lineage
from plumbline.llm.words import as_bytes, lots, mixed

FEWEST, LONGEST = 30, 4
#: A candidate goes if a longer one around it has at least this per cent of its occurrences.
INSIDE_PERCENT = 80
TOP = 2000
#: Bytes of text that are worked on together, about; a longer document goes alone.
LOT_BYTES = 1 << 20
#: Buckets of one range, as a power of two, and of all ranges at most.
RANGE_BITS, BUCKET_BITS = 22, 42
#: Heavy buckets, and slots, that one scan takes along (32 and 72 MB), and keys of a shard on average.
BUNDLE, SLOTS, SHARD = 4 << 20, 4 << 20, 1 << 17
#: Bits of the map of all heavy buckets at most (16 MB), as a power of two.
MAP_BITS = 27
#: Slots of a part of a task's array.
PART = 1 << 15
#: Bytes from which a word is hashed by itself, and such words that a task remembers before it starts again.
LONG_WORD, NUMBERED = 64, 100_000
#: Phrases that a task knows to have sent before it starts again (two places of 8 bytes each), and phrases of a batch that it sends.
SENT, SENDING = 8 << 20, 1 << 16

_MARKS = b".,;:!?\n\x0b\x0c\r"
#: A-Z lower-cased, marks as commas. A comma ends a piece, a semicolon a document.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _MARKS, b"abcdefghijklmnopqrstuvwxyz" + b"," * len(_MARKS))
_B, _L, _64 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
_BASE, _LANG = np.uint64(_B), np.uint64(_L)
#: What the two halves of a word's hash start from, and the odd factors of its eight bytes.
_SEEDS, _FACTORS = (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3), (1, 0xA0761D6478BD642F)
#: By bytes left of a word, those of the next eight that are its own.
_OWN = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
_LEVELS = 100


class _Numbers(dict):
    """Both halves of a 128-bit hash of long words, remembered."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = self[word] = divmod(xxhash.xxh3_128_intdigest(word), 1 << 64)
        return found


@lru_cache(maxsize=100_000)
def _halves(word: bytes) -> tuple[int, int]:
    """Both halves of a word's hash, as ``_word_halves`` has them."""
    if len(word) > LONG_WORD:
        return divmod(xxhash.xxh3_128_intdigest(word), 1 << 64)
    halves = [_mixed(seed + len(word) & _64) for seed in _SEEDS]
    for at in range(0, len(word), 8):
        own = int.from_bytes(word[at : at + 8], "little")
        halves = [_mixed(half ^ own * factor & _64) for half, factor in zip(halves, _FACTORS, strict=True)]
    return halves[0], halves[1]


def _word_halves(data: np.ndarray, start: np.ndarray, size: np.ndarray, numbers: _Numbers) -> list[np.ndarray]:
    """Both halves of the hash of the words at ``start``, eight bytes of all of them at a time; words of up to eight bytes of one size never share one."""
    halves = [mixed(np.uint64(seed) + size.astype(np.uint64)) for seed in _SEEDS]
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    rest = None
    for done in range(0, LONG_WORD, 8):
        rest = np.flatnonzero(size <= LONG_WORD) if rest is None else rest[size[rest] > done]
        if not len(rest):
            break
        own = eights[start[rest] + done] & _OWN[np.minimum(size[rest] - done, 8)]
        for half, factor in zip(halves, _FACTORS, strict=True):
            half[rest] = mixed(half[rest] ^ own * np.uint64(factor))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        halves[0][i], halves[1][i] = numbers[data[start[i] : start[i] + size[i]].tobytes()]
    return halves


class Phrases:
    """All phrases of some texts by the place where they begin; ``whole(n)`` tells whether the n words from a place lie in one piece."""

    def __init__(self, texts: list[bytes | None], langs: list[bytes], numbers: _Numbers):
        plain = [t.translate(_PLAIN) if t else b"" for t in texts]
        joined = b";".join(plain) + b";"
        self.data = np.frombuffer(joined + bytes(8), dtype=np.uint8)
        own = self.data[: len(joined)]
        marks = (own == ord(",")) | (own == ord(";"))
        self.inside = ~(marks | (own == ord(" ")) | (own == ord("\t")))
        edges = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        if self.inside[0]:
            edges = np.concatenate(([0], edges))
        self.start, self.end = edges[::2], edges[1::2]
        self.piece = np.cumsum(marks, dtype=np.int32)[self.start]
        self.langs = sorted(set(langs))
        number = {x: i for i, x in enumerate(self.langs)}
        ends = np.cumsum([len(t) + 1 for t in plain])
        words = np.diff(np.searchsorted(self.start, ends), prepend=0)
        self.by_text = np.cumsum(words) - words
        self.lang = np.repeat(np.array([number[x] for x in langs], dtype=np.int64), words)
        self.lang_halves = [np.array(h, dtype=np.uint64) * _LANG for h in zip(*map(_halves, self.langs), strict=True)]
        self.first, self.second = _word_halves(self.data, self.start, self.end - self.start, numbers)
        self.sums, self.length = self.first, 1

    def keys(self, n: int) -> np.ndarray:
        """The first half of the key of the ``n`` words from each place. To be called for 1, 2 and so on."""
        if n > self.length:
            self.sums = self.sums[:-1] * _BASE + self.first[n - 1 :]
            self.length = n
        return mixed(self.sums + self.lang_halves[0][self.lang[: len(self.sums)]])

    def second_halves(self, n: int, at: np.ndarray) -> np.ndarray:
        """The second half of the key of the ``n`` words from each place of ``at``."""
        total = np.zeros(len(at), dtype=np.uint64)
        for i in range(n):
            total = total * _BASE + self.second[at + i]
        return mixed(total + self.lang_halves[1][self.lang[at]])

    def whole(self, n: int) -> np.ndarray:
        return self.piece[: max(0, len(self.piece) - n + 1)] == self.piece[n - 1 :]

    def spelled(self, at: int, n: int) -> str:
        return b" ".join([self.data[a:b].tobytes() for a, b in zip(self.start[at : at + n].tolist(), self.end[at : at + n].tolist(), strict=True)]).decode()

    @cached_property
    def _spaced(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space after each, and where each starts."""
        data, kept = self.data[: len(self.inside)].copy(), self.inside.copy()
        data[self.end], kept[self.end] = ord(" "), True
        sizes = self.end - self.start + 1
        return data[kept], np.cumsum(sizes) - sizes

    def spellings(self, at: np.ndarray, n: int) -> pa.Array:
        """What ``spelled`` gives for each place of ``at``."""
        data, start = self._spaced
        sizes = start[at + n - 1] + (self.end - self.start)[at + n - 1] - start[at]
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        taken = data[np.repeat(start[at] - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype("<i8")), pa.py_buffer(taken)])

    def words_by_lang(self) -> Iterator[tuple[bytes, int]]:
        return zip(self.langs, np.bincount(self.lang, minlength=len(self.langs)).tolist(), strict=True)


class _Sent:
    """64-bit keys in open addressing, looked up and added by arrays. Beyond ``most`` keys it starts again."""

    def __init__(self, most: int):
        self.most = most
        self._start(10)

    def _start(self, bits: int) -> None:
        self.table, self.count = np.zeros(1 << bits, dtype=np.uint64), 0

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.table) - 1)).astype(np.int64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key was added. A key of 0 marks a free place and never counts as added."""
        found, rest, place = np.zeros(len(keys), dtype=bool), np.arange(len(keys)), self._places(keys)
        while len(rest):
            there = self.table[place]
            same = there == keys[rest]
            on = ~same & (there != 0)
            found[rest[same & (there != 0)]] = True
            rest, place = rest[on], (place[on] + 1) & (len(self.table) - 1)
        return found

    def add(self, keys: np.ndarray) -> None:
        """Add different keys, none of them added before."""
        if self.count + len(keys) > self.most:
            self._start(10)
        if 2 * (self.count + len(keys)) > len(self.table):
            keys = np.concatenate([self.table[self.table != 0], keys])
            self._start((2 * len(keys)).bit_length())
        self.count += len(keys)
        place = self._places(keys)
        while len(keys):
            free = self.table[place] == 0
            self.table[place[free]] = keys[free]
            on = self.table[place] != keys
            keys, place = keys[on], (place[on] + 1) & (len(self.table) - 1)


def phrase_key(lang: bytes, phrase: bytes) -> tuple[int, int]:
    """The 128-bit key of a phrase as two halves; the empty phrase stands for all words of a language."""
    first = second = 0
    for a, b in map(_halves, phrase.split()):
        first, second = (first * _B + a) & _64, (second * _B + b) & _64
    a, b = _halves(lang)
    return _mixed((first + a * _L) & _64), _mixed((second + b * _L) & _64)


def _mixed(x: int) -> int:
    """``mixed`` of one number."""
    x = ((x ^ (x >> 33)) * 0xFF51AFD7ED558CCD) & _64
    return ((x ^ (x >> 29)) * 0xC4CEB9FE1A85EC53) & _64


def _scanned(docs: DataFrame, work, schema: str) -> DataFrame:
    """What ``work`` makes of the Phrases of lots of texts, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def phrases() -> Iterator[Phrases]:
            numbers = _Numbers()
            for lot in lots(batches, LOT_BYTES):
                if len(numbers) > NUMBERED:
                    numbers = _Numbers()
                yield Phrases(as_bytes(lot.column("text")), as_bytes(lot.column("lang")), numbers)

        return work(phrases())

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text")).mapInArrow(run, schema)


def heavy_buckets(docs: DataFrame, bits: int, *, fewest: int = FEWEST, longest: int = LONGEST) -> DataFrame:
    """(range long, n long, buckets binary): the buckets, of 2**bits, into which ``fewest`` phrases or more fall, as places in their range.

    A task's counts of a lot stop at 255, or at ``fewest`` if that is more, which changes no verdict.
    """
    kind, most = (np.uint8, 255) if fewest <= 255 else (np.uint32, fewest)
    low = np.uint64(RANGE_BITS)

    def work(lots_of: Iterator[Phrases]) -> Iterator[pa.RecordBatch]:
        for found in lots_of:
            keys = np.concatenate([found.keys(n)[found.whole(n)] for n in range(1, longest + 1)]) >> np.uint64(64 - bits)
            buckets, counts = np.unique(keys, return_counts=True)
            ranges, starts = np.unique(buckets >> low, return_index=True)
            ends = np.append(starts, len(buckets))[1:].tolist()
            places, counts = (buckets & np.uint64((1 << RANGE_BITS) - 1)).astype("<u4"), np.minimum(counts, most).astype(kind)
            rows = [(places[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(starts.tolist(), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ranges.astype(np.int64)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["range", "buckets", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their ranges, so one range is added up at a time."""
        sums, current = np.zeros(1 << min(bits, RANGE_BITS), dtype=np.uint32), None

        def heavy() -> pa.RecordBatch:
            places = np.flatnonzero(sums >= fewest).astype("<u4")
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([len(places)], pa.int64()), pa.array([places.tobytes()], pa.binary())], ["range", "n", "buckets"])

        for batch in batches:
            for own, places, counts in zip(batch.column("range").to_pylist(), batch.column("buckets"), batch.column("counts"), strict=True):
                if own != current:
                    if current is not None:
                        yield heavy()
                    sums[:], current = 0, own
                at = np.frombuffer(places.as_buffer(), dtype="<u4")
                sums[at] = np.minimum(sums[at] + np.frombuffer(counts.as_buffer(), dtype=kind), most)  # the places of a row differ
        if current is not None:
            yield heavy()

    rows = _scanned(docs, work, "range long, buckets binary, counts binary")
    return rows.repartition("range").sortWithinPartitions("range").mapInArrow(summed, "range long, n long, buckets binary").where("n > 0")


@dataclass(frozen=True)
class HeavyMap:
    """A bounded map of all heavy buckets: one bit for several buckets if there are many. It lets every heavy bucket through."""

    bits: int
    fold: int
    known: np.ndarray

    def passes(self, keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(64 - self.bits + self.fold)
        return (self.known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def phrases(self, found: Phrases, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, places, keys) of the phrases that are heavy with all their parts."""
        shorter = None
        for n in range(1, longest + 1):
            keys, here = found.keys(n), found.whole(n)
            if shorter is not None:
                here &= shorter[:-1] & shorter[1:]
            at = np.flatnonzero(here)
            at = at[self.passes(keys[at])]
            shorter = np.zeros(len(here), dtype=bool)
            shorter[at] = True
            yield n, at, keys[at]


def _heavy_map(heavy: DataFrame, bits: int, count: int) -> HeavyMap:
    fold = max(0, bits - min(MAP_BITS, max(16, math.ceil(math.log2(64 * max(1, count))))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, places in zip(batch.column("range").to_pylist(), batch.column("buckets").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique((own << RANGE_BITS) + np.frombuffer(places, dtype="<u4").astype(np.int64) >> fold))], ["bit"])

    return HeavyMap(bits, fold, bits_of(heavy.mapInArrow(run, "bit long"), bits - fold))


def _lanes(docs: DataFrame) -> int:
    """Tasks that scan for what each of them sends on once, however much of the input it reads."""
    return 2 * max(1, docs.sparkSession.sparkContext.defaultParallelism)


def _bundles(sizes: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Neighbouring ranges, from (range, buckets), with at most ``most`` buckets together or one range alone, as (first, last)."""
    found, total = [], 0
    for own, n in sorted(sizes):
        if not found or total + n > most:
            found.append((own, own))
            total = 0
        found[-1] = (found[-1][0], own)
        total += n
    return found


def candidate_phrases(docs: DataFrame, heavy: DataFrame, heavy_map: HeavyMap, *, longest: int = LONGEST, bundle: int = BUNDLE) -> DataFrame:
    """(lang, phrase): every phrase that lies in a heavy bucket with all its parts, and the empty phrase of each language."""
    found = None
    sizes = [(r.range, r.n) for r in heavy.select("range", "n").toLocalIterator()]  # 2**(BUCKET_BITS - RANGE_BITS) ranges at most
    shift = np.uint64(64 - heavy_map.bits)
    for number, (first, last) in enumerate(_bundles(sizes, bundle)):
        own = [(r.range << RANGE_BITS) + np.frombuffer(r.buckets, dtype="<u4").astype(np.uint64) for r in heavy.where(F.col("range").between(first, last)).toLocalIterator()]
        shared = docs.sparkSession.sparkContext.broadcast((heavy_map, np.sort(np.concatenate(own))))

        def work(lots_of: Iterator[Phrases], shared=shared, number=number, first=first, last=last) -> Iterator[pa.RecordBatch]:
            known, buckets = shared.value
            low, high = first << RANGE_BITS, (last + 1 << RANGE_BITS) - 1
            sent, langs = _Sent(SENT), set()
            for found in lots_of:
                names = pa.array([x.decode() for x in found.langs], pa.large_string())
                if not number and (new := [i for i, x in enumerate(found.langs) if x not in langs]):
                    langs.update(found.langs)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(new)).cast(pa.string()), pa.array([""] * len(new), pa.string())], ["lang", "phrase"])
                for n, at, keys in known.phrases(found, longest):
                    bucket = keys >> shift
                    new = np.flatnonzero((bucket >= low) & (bucket <= high))
                    new = new[~sent.has(keys[new])]
                    own, once = np.unique(keys[new], return_index=True)
                    at, bucket = at[new[once]], own >> shift
                    mine = buckets[np.minimum(np.searchsorted(buckets, bucket), len(buckets) - 1)] == bucket
                    at = at[mine]
                    sent.add(own[mine])
                    for some in (at[i : i + SENDING] for i in range(0, len(at), SENDING)):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(found.lang[some])).cast(pa.string()), found.spellings(some, n).cast(pa.string())], ["lang", "phrase"])

        part = _scanned(docs.coalesce(_lanes(docs)), work, "lang string, phrase string").distinct()
        found = part if found is None else found.union(part)
    return found


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash of different keys (n, 2): sizes of the levels in words of 64 bits, the words of all levels, the keys by slot."""
    sizes, words, ordered = [], [np.zeros(0, dtype=np.uint64)], [np.zeros((0, 2), dtype=np.uint64)]
    while len(keys):
        if len(sizes) == _LEVELS:
            raise ValueError("different phrases share a 128-bit key")
        size = len(keys) // 32 + 1
        place = _place(keys[:, 0], keys[:, 1], len(sizes), np.uint64(size * 64))
        alone = np.bincount(place.astype(np.int64), minlength=size * 64) == 1
        stays = alone[place]
        order = np.argsort(place[stays])
        sizes.append(size)
        words.append(np.packbits(alone.reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel())
        ordered.append(keys[stays][order])
        keys = keys[~stays]
    return sizes, np.concatenate(words), np.concatenate(ordered)


def _place(first: np.ndarray, second: np.ndarray, level: int, size: np.ndarray | np.uint64) -> np.ndarray:
    return mixed(first + second * np.uint64(2 * level + 1)) % size


class SlotTable:
    """The perfect hashes of several shards: slots of all their keys one after another."""

    def __init__(self, shards: int, built: list[tuple[int, list[int], np.ndarray, np.ndarray]]):
        """``shards``: how many there are in all; ``built``: number and perfect hash of those that this table has."""
        self.shards = np.uint64(shards)
        depth = max([len(sizes) for _, sizes, _, _ in built], default=0)
        self.sizes, self.starts = (np.zeros((depth, shards), dtype=np.int64) for _ in range(2))
        words, keys, start = [np.zeros(0, dtype=np.uint64)], [np.zeros((0, 2), dtype=np.uint64)], 0
        for number, sizes, own_words, own_keys in built:
            for level, size in enumerate(sizes):
                self.sizes[level, number], self.starts[level, number] = size, start
                start += size
            words.append(own_words)
            keys.append(own_keys)
        self.words, self.keys = np.concatenate(words), np.concatenate(keys)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        found = np.full(len(first), -1, dtype=np.int64)
        shard = (second % self.shards).astype(np.int64)
        rest = np.arange(len(first))
        for level, (sizes, starts) in enumerate(zip(self.sizes, self.starts, strict=True)):
            rest = rest[sizes[shard[rest]] > 0]
            own = shard[rest]
            place = _place(first[rest], second[rest], level, (sizes[own] * 64).astype(np.uint64))
            word, bit = starts[own] + (place >> np.uint64(6)).astype(np.int64), place & np.uint64(63)
            hit = (self.words[word] >> bit & np.uint64(1)).astype(bool)
            at, word, bit = rest[hit], word[hit], bit[hit]
            slot = self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            same = (self.keys[slot, 0] == first[at]) & (self.keys[slot, 1] == second[at])
            found[at[same]] = slot[same]
            rest = rest[~hit]
        return found


class _Candidates:
    """The keys of candidate phrases, of their languages and of the parts of their cuts, all at once."""

    def __init__(self, batch: pa.RecordBatch):
        """``batch``: (lang, phrase); the empty phrase stands for all words of its language."""
        phrases = as_bytes(batch.column("phrase"))
        self.sizes = np.array([p.count(b" ") + 1 if p else 0 for p in phrases], dtype=np.int64)
        self.langs = as_bytes(batch.column("lang"))
        self.found = Phrases(phrases, self.langs, _Numbers())
        self.first = [self.found.keys(n) for n in range(1, max([1, *self.sizes.tolist()]) + 1)]

    def keys(self, what: int) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the keys of the phrases (what 0), their languages (1), or the first or last part of the cut after k words (2k and 2k + 1); of phrases of k words or fewer, no key that counts."""
        k, last = divmod(what, 2)
        start, sizes = (self.found.by_text + k, self.sizes - k) if last else (self.found.by_text, np.minimum(self.sizes, k) if k else self.sizes)
        if what == 1:
            sizes = np.zeros_like(sizes)
        first, second = (np.zeros(len(sizes), dtype=np.uint64) for _ in range(2))
        for n in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == n)
            first[own], second[own] = self.first[n - 1][start[own]], self.found.second_halves(n, start[own])
        empty = np.flatnonzero(sizes == 0)
        of = {x: phrase_key(x, b"") for x in self.found.langs}
        if len(empty):
            first[empty], second[empty] = (np.array(half, dtype=np.uint64) for half in zip(*(of[self.langs[i]] for i in empty.tolist()), strict=True))
        return first, second


def _built(candidates: DataFrame, shards: int) -> DataFrame:
    """(shard, n, sizes, words, keys): the perfect hash of each shard of the candidates."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = _Candidates(batch).keys(0)
            yield pa.RecordBatch.from_arrays([pa.array((second % np.uint64(shards)).astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (first, second))], ["shard", "first", "second"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.stack([table.column(c).to_numpy().view(np.uint64) for c in ("first", "second")], axis=1)
        sizes, words, ordered = perfect_hash(keys)
        return pa.table({"shard": table.column("shard")[:1], "n": [len(keys)], "sizes": pa.array([sizes], pa.list_(pa.int64())), "words": [words.tobytes()], "keys": [ordered.tobytes()]})

    return candidates.mapInArrow(keyed, "shard long, first long, second long").groupBy("shard").applyInArrow(build, "shard long, n long, sizes array<long>, words binary, keys binary")


def _tree_sum(rows: DataFrame, lanes: int) -> DataFrame:
    """Arrays of (lane, part, counts) summed by part, in two steps so that no task holds more than the root of all."""

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(1, dtype=np.int64)
        for counts in table.column("counts"):
            total = total + np.frombuffer(counts.as_py(), dtype="<i8")
        return pa.table({"lane": table.column("lane")[:1], "part": table.column("part")[:1], "counts": [total.tobytes()]})

    schema = "lane long, part long, counts binary"
    some = rows.withColumn("lane", F.col("lane") % math.ceil(math.sqrt(lanes)))
    return some.groupBy("lane", "part").applyInArrow(summed, schema).groupBy("part").applyInArrow(summed, schema)


def slot_counts(docs: DataFrame, table, heavy_map: HeavyMap, size: int, *, longest: int = LONGEST) -> np.ndarray:
    """Occurrences by slot of ``table``, a broadcast SlotTable of ``size`` slots."""
    context = docs.sparkSession.sparkContext
    lanes = _lanes(docs)
    shared_map = context.broadcast(heavy_map)

    def work(lots_of: Iterator[Phrases]) -> Iterator[pa.RecordBatch]:
        own, known = table.value, shared_map.value
        counts = np.zeros(-(-max(1, size) // PART) * PART, dtype=np.int64)
        for found in lots_of:
            slots = []
            for n, at, keys in known.phrases(found, longest):
                slots.append(own.slots(keys, found.second_halves(n, at)))
            slots = np.concatenate(slots)
            slots = slots[slots >= 0]
            if len(slots):
                own_counts = np.bincount(slots)
                counts[: len(own_counts)] += own_counts
            for lang, n in found.words_by_lang():
                if (slot := own.slots(*(np.array([k], dtype=np.uint64) for k in phrase_key(lang, b"")))[0]) >= 0:
                    counts[slot] += n
        parts = [(i, p) for i, p in enumerate(counts.reshape(-1, PART)) if p.any()]
        if parts:
            lane = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([lane] * len(parts), pa.int64()), pa.array([i for i, _ in parts], pa.int64()), pa.array([p.astype("<i8").tobytes() for _, p in parts], pa.binary())], ["lane", "part", "counts"])

    rows = _scanned(docs.coalesce(lanes), work, "lane long, part long, counts binary")
    counts = np.zeros(-(-max(1, size) // PART) * PART, dtype=np.int64)
    for r in _tree_sum(rows, lanes).toLocalIterator():
        counts[r.part * PART : (r.part + 1) * PART] = np.frombuffer(r.counts, dtype="<i8")
    return counts[:size]


def _read(candidates: DataFrame, table, counts, longest: int) -> DataFrame:
    """(lang, phrase, f0, f1, ...): counts that ``table`` has of a phrase (f0), its language (f1), and the first and last part of its cut after k words (2k and 2k + 1); null if it has none."""
    names = [f"f{what}" for what in range(2 * longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = table.value, counts.value
        for batch in batches:
            found = _Candidates(batch)
            columns = []
            for what in range(2 * longest):
                slots = own.slots(*found.keys(what))
                there = (slots >= 0) & (found.sizes > max(1, what // 2))
                f = np.zeros(len(slots), dtype=np.int64)
                f[there] = numbers[slots[there]]
                columns.append(pa.array(f, mask=~there))
            yield pa.RecordBatch.from_arrays([batch.column("lang").cast(pa.string()), batch.column("phrase").cast(pa.string()), *columns], ["lang", "phrase", *names])

    return candidates.where("phrase <> ''").mapInArrow(run, "lang string, phrase string, " + ", ".join(f"{x} long" for x in names))


def phrase_counts(docs: DataFrame, *, fewest: int = FEWEST, longest: int = LONGEST, bucket_bits: int | None = None, bundle: int = BUNDLE, slots: int = SLOTS, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, a, n, cuts): phrases of 2 to ``longest`` words with ``fewest`` occurrences, words of the language, and (k, l, r) of each cut."""
    context = docs.sparkSession.sparkContext
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits or min(BUCKET_BITS, max(24, math.ceil(math.log2(max(1, size)))))
    heavy = cut_lineage(heavy_buckets(docs, bits, fewest=fewest, longest=longest))
    total = heavy.agg(F.sum("n")).first()[0]
    if not total:
        return docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, n long, cuts array<struct<k: int, l: long, r: long>>")
    heavy_map = _heavy_map(heavy, bits, total)
    candidates = cut_lineage(candidate_phrases(docs, heavy, heavy_map, longest=longest, bundle=bundle))
    shards = -(-candidates.count() // shard)
    built = cut_lineage(_built(candidates, shards))
    rows, tables = None, 0
    for first, last in _bundles([(r.shard, r.n) for r in built.select("shard", "n").collect()], slots):
        own = [(r.shard, r.sizes, np.frombuffer(r.words, dtype="<u8"), np.frombuffer(r.keys, dtype="<u8").reshape(-1, 2)) for r in built.where(F.col("shard").between(first, last)).toLocalIterator()]
        table = SlotTable(shards, own)
        shared = context.broadcast(table)
        counts = slot_counts(docs, shared, heavy_map, len(table), longest=longest)
        part = _read(candidates, shared, context.broadcast(counts), longest)
        rows = part if rows is None else rows.union(part)
        tables += 1

    whole = rows.groupBy("lang", "phrase").agg(*(F.max(f"f{what}").alias(f"f{what}") for what in range(2 * longest))) if tables > 1 else rows
    cuts = [F.struct(F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r")) for k in range(1, longest)]
    found = whole.where(F.col("f0") >= fewest).select("lang", "phrase", F.col("f0").alias("a"), F.col("f1").alias("n"), F.array(*cuts).alias("cuts"))
    return found.withColumn("cuts", F.filter("cuts", lambda c: c["l"].isNotNull()))


def _exact(number: Column | int) -> Column:
    return (F.lit(number) if isinstance(number, int) else number).cast("decimal(20,0)")


def collocations(docs: DataFrame, *, fewest: int = FEWEST, longest: int = LONGEST, inside_percent: int = INSIDE_PERCENT, top: int = TOP, **how) -> DataFrame:
    """The best ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased, texts split into pieces at the marks and line ends, pieces into words. The
    score of a phrase is floor(2000000 * a / (l + r)) at its lowest-scoring cut, of equal ones the
    first. Phrases go that lie within a longer one, itself kept or not, with ``inside_percent`` of
    their occurrences or more. Order: score and a descending, phrase ascending by bytes.

    Null texts are empty; a null language is ``und``; repeated rows count each; an empty table, or
    one without a phrase of ``fewest`` occurrences, gives no row. Very long texts are worked on
    whole. Columns beside text and lang are not read.
    """
    found = cut_lineage(phrase_counts(docs, fewest=fewest, longest=longest, **how))
    a, size = F.col("a"), F.size(F.split("phrase", " "))
    quotient = "CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(20,0)) AS DECIMAL(28,0)) div (CAST(c.l AS DECIMAL(20,0)) + CAST(c.r AS DECIMAL(20,0)))"
    best = F.expr(f"array_min(transform(cuts, c -> struct({quotient} AS score, c.k AS k, c.l AS l, c.r AS r)))")
    parts = {n: f"transform(sequence(1, size(split(phrase, ' ')) - {n - 1}), i -> array_join(slice(split(phrase, ' '), i, {n}), ' '))" for n in range(2, longest)}
    longer = [found.where(size > n).select("lang", F.explode(F.expr(p)).alias("phrase"), "a") for n, p in parts.items()]
    kept = found.select("lang", "phrase", "a", "n", best.alias("best"))
    if longer:
        around = longer[0]
        for other in longer[1:]:
            around = around.union(other)
        kept = kept.join(around.groupBy("lang", "phrase").agg(F.max("a").alias("around")), ["lang", "phrase"], "left")
        kept = kept.where(F.col("around").isNull() | (_exact(100) * _exact(F.col("around")) < _exact(inside_percent) * _exact(a)))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
