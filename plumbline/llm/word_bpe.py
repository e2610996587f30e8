"""Byte pair encoding with word ends: a segment tree over the ranks of neighbours gives the next merge.

A word is a row of symbols, at first its bytes. Leaf i of the tree holds the rank of symbol i and
its right neighbour; an inner node holds the lesser of its two children. As a leaf's value has the
rank above the place, the root is the lowest rank and, of equal ones, the leftmost. A merge
changes at most three leaves, each renewed on its way to the root, so a word of n bytes costs
O(n log n) however long it is. The trees of the new words of a lot of texts stand side by side in
one array and are worked off in step; long words go one by one.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from plumbline.llm.words import lots

#: A tokenizer file of the library with word ends; it must be on every machine, as libraries are.
TOKENIZER_PATH = "/opt/tokenizers/word_bpe_49k.json"
#: Words, and bytes of words, that a worker remembers.
REMEMBERED, REMEMBERED_BYTES = 500_000, 16_000_000

#: Bytes of text whose new words are encoded together, about; a longer document goes alone.
LOT_BYTES = 1 << 20
#: Leaves of the trees that stand side by side; longer words go one by one.
WIDTHS = (8, 16, 32, 64)
#: Words whose trees stand side by side.
SIDE_BY_SIDE = 1 << 14

_NONE = 1 << 62
#: A symbol that is in no pair.
_GONE = 0xFFFF
_PLACE = (1 << 40) - 1
#: Up to this character letters and digits are the same in every version of Unicode that the libraries may follow.
_SETTLED = "\u024f"
#: White space up to there.
_SPACE = "\t-\r \x85\xa0"


def _ranges(of) -> str:
    """The settled characters for which ``of`` holds, for a character class."""
    return "".join(re.escape(c) for c in map(chr, range(ord(_SETTLED) + 1)) if of(c))


@dataclass(frozen=True)
class WordVocabulary:
    """What encoding needs of a tokenizer file: ids of single bytes inside and at the end of a word, ranks by pair of ids, what a merge of each rank makes, text of each id."""

    inside: tuple[int, ...]
    last: tuple[int, ...]
    ranks: dict[int, int]
    made: list[int]
    tokens: dict[int, bytes]
    special: dict[str, int]
    path: str


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable in Latin-1, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


def load_vocabulary(path: str = TOKENIZER_PATH) -> WordVocabulary:
    """Read a tokenizer file on the driver; the result is as small as the vocabulary and goes to the tasks by broadcast."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    model = content["model"]
    ids, end = model["vocab"], model["end_of_word_suffix"]
    chars = byte_characters()
    ranks: dict[int, int] = {}
    for rank, (left, right) in enumerate(model["merges"]):
        ranks.setdefault(ids[left] << 16 | ids[right], rank)
    made = [ids[left + right] for left, right in model["merges"]]
    special = {t["content"]: t["id"] for t in content["added_tokens"]}
    tokens = {i: t.encode() for t, i in (ids | special).items()}
    return WordVocabulary(tuple(ids[c] for c in chars), tuple(ids[c + end] for c in chars), ranks, made, tokens, special, path)


def merge_word(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols left when the leftmost pair of lowest rank is merged until no pair can be.

    ``ranks`` has the rank of a pair by its two ids, ``made`` the id that the merge of a rank makes.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of = ranks.get
    width = 1 << (n - 2).bit_length()
    leaves = [_NONE if (r := rank_of(x << 16 | y)) is None else r << 40 | i for i, (x, y) in enumerate(zip(symbols, symbols[1:]))]
    tree = [_NONE] * width + leaves + [_NONE] * (width - n + 1)
    for node in range(width - 1, 0, -1):
        x, y = tree[2 * node], tree[2 * node + 1]
        tree[node] = x if x < y else y
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) != _NONE:
        place = root & _PLACE
        gone = after[place]
        follows, precedes = after[gone], before[place]
        symbols[place] = made[root >> 40]
        after[place] = follows
        changed = [(place, _NONE)]
        if follows < n:
            before[follows] = place
            changed = [(gone, _NONE), (place, _NONE if (r := rank_of(symbols[place] << 16 | symbols[follows])) is None else r << 40 | place)]
        elif gone < n - 1:
            changed.append((gone, _NONE))
        if precedes >= 0:
            changed.append((precedes, _NONE if (r := rank_of(symbols[precedes] << 16 | symbols[place])) is None else r << 40 | precedes))
        for at, leaf in changed:
            node = width + at
            tree[node] = leaf
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                least = leaf if leaf < other else other
                if tree[node] == least:
                    break
                tree[node] = leaf = least
    kept, place = [], 0
    while place < n:
        kept.append(symbols[place])
        place = after[place]
    return kept


class PairRanks:
    """Ranks of many pairs at once, by binary search among the sorted pairs."""

    def __init__(self, vocabulary: WordVocabulary):
        self.pairs = np.array(sorted(vocabulary.ranks), dtype=np.int64)
        self.ranks = np.array([vocabulary.ranks[p] for p in self.pairs.tolist()], dtype=np.int64) << 40
        self.made = np.array(vocabulary.made, dtype=np.int64)

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The value of the leaf at ``place`` for the symbols ``left`` and ``right``."""
        pair = left << 16 | right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.ranks[at] | place, _NONE)


def merge_side_by_side(rows: np.ndarray, pairs: PairRanks) -> np.ndarray:
    """As ``merge_word`` for each row of symbols. A row begins and ends with at least one ``_GONE``; what is merged away becomes ``_GONE`` too.

    The number of columns, a power of two, is the number of leaves. All rows make their next merge at once.
    """
    count, width = rows.shape
    places = np.arange(width)
    symbols = rows.astype(np.int64).ravel()
    tree = np.full((count, 2 * width), _NONE, dtype=np.int64)
    tree[:, width:-1] = pairs.leaves(rows[:, :-1], rows[:, 1:], places[:-1])
    for node in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
    tree = tree.ravel()
    after, before = np.tile(np.minimum(places + 1, width - 1), count), np.tile(np.maximum(places - 1, 0), count)
    live = np.arange(count)
    while len(live := live[(root := tree[live * 2 * width + 1]) != _NONE]):
        root = root[root != _NONE]
        row, top = live * width, live * 2 * width
        place = root & _PLACE
        gone = after[row + place]
        follows, precedes = after[row + gone], before[row + place]
        merged = pairs.made[root >> 40]
        symbols[row + place], symbols[row + gone] = merged, _GONE
        after[row + place], before[row + follows] = follows, place
        nodes = [width + gone, width + place, width + precedes]
        tree[top + nodes[0]] = _NONE
        tree[top + nodes[1]] = pairs.leaves(merged, symbols[row + follows], place)
        tree[top + nodes[2]] = pairs.leaves(symbols[row + precedes], merged, precedes)
        for _ in range(width.bit_length() - 1):
            for i, node in enumerate(nodes):
                up = node >> 1
                tree[top + up] = np.minimum(tree[top + 2 * up], tree[top + 2 * up + 1])
                nodes[i] = up
    return symbols.reshape(count, width)


class WordEncoder(dict):
    """Ids and decoded text of words, remembered: a word to (ids as little-endian bytes, decoded text)."""

    def __init__(self, vocabulary: WordVocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        library = Tokenizer.from_file(vocabulary.path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {c: b for b, c in enumerate(byte_characters())}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        endings = "'s|'t|'re|'ve|'m|'ll|'d"
        letters, digits = (_ranges(lambda c, k=k: unicodedata.category(c)[0] == k) for k in "LN")
        self.pattern = re.compile(f"{endings}|[{letters}]+|[{digits}]|[^{_SPACE}{letters}{digits}]+")
        self.settled = re.compile(f"[\\0-{_SETTLED}]*")
        self.size = 0

        self.pairs = PairRanks(vocabulary)
        self.first = np.array([vocabulary.inside, vocabulary.last], dtype=np.int64)

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        own, text = self.vocabulary, word.encode()
        return self.packed(merge_word([*map(own.inside.__getitem__, text[:-1]), own.last[text[-1]]], own.ranks, own.made))

    def packed(self, ids: list[int]) -> tuple[bytes, bytes]:
        return np.array(ids, dtype="<u4").tobytes(), b" ".join([self.vocabulary.tokens[i] for i in ids])

    def learn(self, words: set[str]) -> None:
        """Remember words, so that the lot that has them finds all but the longest ones."""
        new = words.difference(self)
        if len(self) + len(new) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.clear()
            self.size, new = 0, words
        texts = sorted((w.encode() for w in new), key=len)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        for low, width in zip((0, *(w - 2 for w in WIDTHS)), WIDTHS):
            at, end = np.searchsorted(sizes, [low + 1, width - 1])
            for start in range(at, end, SIDE_BY_SIDE):
                self._learn(texts[start : min(end, start + SIDE_BY_SIDE)], width)

    def _learn(self, texts: list[bytes], width: int) -> None:
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        self.size += int(ends[-1])
        which = np.repeat(np.arange(len(texts)), sizes)
        column = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        rows = np.full((len(texts), width), _GONE, dtype=np.int64)
        rows[which, column + 1] = self.first[(column + 1 == sizes[which]).astype(np.int64), np.frombuffer(b"".join(texts), dtype=np.uint8)]
        rows = merge_side_by_side(rows, self.pairs)
        there = rows != _GONE
        ids = rows[there]
        packed, spelled = ids.astype("<u4").tobytes(), [*map(self.vocabulary.tokens.__getitem__, ids.tolist())]
        start = 0
        for text, end in zip(texts, np.cumsum(there.sum(axis=1)).tolist(), strict=True):
            self[text.decode()] = packed[4 * start : 4 * end], b" ".join(spelled[start:end])
            start = end

    def words(self, text: str) -> list[str]:
        """The words of a piece of text without special tokens. Normal form and, beyond the settled characters, the split are the library's."""
        text = text.lower() if text.isascii() else self.normalise(text)
        if self.settled.fullmatch(text):
            return self.pattern.findall(text)
        return [bytes(map(self.bytes_of.__getitem__, shown)).decode() for shown, _ in self.split(text)]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Of each text the ids as little-endian unsigned 32-bit integers, and the decoded text in UTF-8."""
        pieces = [self.special.split(t) if t and self.special else [t] if t else [] for t in texts]
        words = [[[p] if p in self.vocabulary.special else self.words(p) for p in ps if p] for ps in pieces]
        self.learn(set().union(*itertools.chain.from_iterable(words)))
        found = []
        for ps, pieces_words in zip(pieces, words, strict=True):
            parts: list[tuple[bytes, bytes]] = []
            for piece, own in zip(filter(None, ps), pieces_words, strict=True):
                if piece in self.vocabulary.special:
                    parts.append(self.packed([self.vocabulary.special[piece]]))
                else:
                    parts += map(self.__getitem__, own)
            found.append((b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])))
        return found


_WORKER: dict[str, WordEncoder] = {}


def _encoded(docs: DataFrame, path: str, rows, schema: str) -> DataFrame:
    """What ``rows`` makes of the encoded texts of a batch, with doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER.clear()
            _WORKER[path] = WordEncoder(shared.value)
        encoder = _WORKER[path]
        for lot in lots(batches, LOT_BYTES):
            yield pa.RecordBatch.from_arrays([lot.column("doc_id"), *rows(encoder.encode(lot.column("text").to_pylist()))], names)

    names = [f.split()[0] for f in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def encode_words(docs: DataFrame, *, path: str = TOKENIZER_PATH) -> DataFrame:
    """doc_id and ``ids``, an array of int, of every document.

    The ids are the library's without special tokens added, truncation or padding; special tokens
    that a text spells out keep their ids. Null and empty texts have no ids. Repeated rows each give
    a row, null doc_ids stay null, an empty table gives an empty result. Columns beside doc_id and
    text are not read.
    """

    def rows(found: list[tuple[bytes, bytes]]) -> list[pa.Array]:
        starts = np.cumsum([0, *(len(ids) // 4 for ids, _ in found)], dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(ids for ids, _ in found), dtype="<i4")))]

    return _encoded(docs, path, rows, "doc_id long, ids array<int>")


def decode_words(encoded: DataFrame, *, path: str = TOKENIZER_PATH) -> DataFrame:
    """doc_id and ``text`` of rows of doc_id and ids, as the library decodes without a decoder: tokens joined by spaces, special ones kept.

    Ids that are not in the vocabulary are passed over; null and empty ids give an empty text.
    """
    tokens = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(path).tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens.value
        for batch in batches:
            texts = [b" ".join([known[i] for i in ids.as_py() or () if i in known]).decode() for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def word_bpe_digest(docs: DataFrame, *, path: str = TOKENIZER_PATH) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers), decoded_sha256 (decoded text in UTF-8).

    One pass encodes and decodes, so neither ids nor texts are stored. Null text counts as empty: no
    tokens, digests of nothing. Otherwise as ``encode_words``.
    """

    def rows(found: list[tuple[bytes, bytes]]) -> list[pa.Array]:
        digests = [pa.array([hashlib.sha256(f[i]).hexdigest() for f in found], pa.string()) for i in (0, 1)]
        return [pa.array([len(f[0]) // 4 for f in found], pa.int64()), *digests]

    return _encoded(docs, path, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
