"""Substring deduplication: automata of recurring phrases locate every occurrence of recurring passages.

Documents are dealt into blocks of bounded size by a hash, once; that exchange serves all three
passes, each of which visits whole blocks:

1. nominate: winnowed phrases (the least phrase hash in each window) that start in two documents,
   a small fraction of all word positions;
2. confirm: hashes of whole windows around those phrases, with the smallest document that has each,
   and the words of each phrase, from the smallest document that has it;
3. locate: the dictionary of phrases is dealt out to the blocks that sighted them, each compiles
   its share into an Aho-Corasick automaton over word ids and streams all its documents through it.
   A hit is a phrase word for word; the windows around it that were confirmed are its passage.

A window has its least phrase wherever it occurs, so no occurrence is without a hit. Before each
shuffle a block reduces its hashes to one row with the smallest and largest doc_id, so a passage
that a third of all documents share gives one row per block and no hot group.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm.words import Block, Vocabulary, as_bytes, mixed, rolling, sliding_min

#: Words of a nominating phrase; a window of 50 has 35 of them, of which the least is sent.
PHRASE = 16
#: Bytes of text in a block, on average.
BLOCK_BYTES = 8 << 20
FEWEST_BLOCKS = 64

_SIGHTINGS = pa.schema([("key", pa.int64()), ("more", pa.int32()), ("block", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("phrase", pa.string())])
#: ``more`` of the rows of phrases; those of windows have further bits of their hash there.
_OF_PHRASE = -1
_OTHER = np.uint64(0xA0761D6478BD642F)


#: The words of earlier blocks of a Python worker, which spares numbering and hashing them again; bounded.
REMEMBERED = 500_000
_WORKER = Vocabulary()


class _Passages:
    """A block of documents with the hashes of its windows."""

    def __init__(self, table: pa.Table, window: int):
        self.ids = table.column("doc_id").to_pylist()
        if len(_WORKER) > REMEMBERED:
            _WORKER.clear()
        self.words = Block(as_bytes(table.column("text")), _WORKER)
        self.window = window
        named = np.array([x is not None for x in self.ids], dtype=bool)
        numbers = np.array([x or 0 for x in self.ids], dtype=np.int64)
        owner = self.words.owner()
        count = max(0, len(owner) - window + 1)
        self.whole = self.words.whole(window) & named[owner[:count]]
        self.doc = numbers[owner]
        self.phrases = rolling(self.words.hashes, PHRASE)
        width = window - PHRASE + 1
        self.phrase = sliding_min(self.phrases, width) if len(self.phrases) >= width else np.zeros(0, dtype=np.uint64)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """64 bits of a hash of each window, and 16 of another one."""
        other = rolling(mixed(self.words.hashes ^ _OTHER), self.window)
        return rolling(self.words.hashes, self.window), (other >> np.uint64(48)).astype(np.int32)


def _sightings(keys: np.ndarray, more: np.ndarray, docs: np.ndarray, block: int) -> pa.Table:
    """One row per key: the smallest and the largest document of the block that has it."""
    order = np.lexsort((docs, more, keys))
    keys, more, docs = keys[order], more[order], docs[order]
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])))) if len(keys) else np.zeros(0, dtype=np.int64)
    last = np.concatenate((first[1:], [len(keys)])) - 1 if len(keys) else first
    return pa.table([keys[first].view(np.int64), more[first], np.full(len(first), block), docs[first], docs[last], pa.nulls(len(first), pa.string())], schema=_SIGHTINGS)


def _nominate(window: int):
    def run(key, table):
        block = _Passages(table, window)
        keys, docs = block.phrase[block.whole], block.doc[: len(block.whole)][block.whole]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))) if len(keys) else np.zeros(0, dtype=bool)
        return _sightings(keys[new], np.full(int(new.sum()), _OF_PHRASE, dtype=np.int32), docs[new], key[0].as_py())

    return run


def _phrase_words(block: _Passages, keys: np.ndarray) -> list[str | None]:
    """The words of a phrase of the block with each of ``keys``."""
    order = np.argsort(keys)
    at = np.flatnonzero(np.isin(block.phrases, keys))
    words: list[str | None] = [None] * len(keys)
    if len(at):
        _, first = np.unique(block.phrases[at], return_index=True)
        at = at[first]
        for place, to in zip(at.tolist(), order[np.searchsorted(keys[order], block.phrases[at])].tolist(), strict=True):
            words[to] = b" ".join(block.words.words[place : place + PHRASE]).decode()
    return words


def _confirm(window: int):
    def run(key, table, nominated):
        if not table.num_rows or not nominated.num_rows:
            return _SIGHTINGS.empty_table()
        block = _Passages(table, window)
        wanted = nominated.column("key").to_numpy().view(np.uint64)
        near = block.whole & np.isin(block.phrase, wanted)
        keys, more = block.hashes()
        windows = _sightings(keys[near], more[near], block.doc[: len(near)][near], key[0].as_py())
        # a phrase is spelled out by the block of its smallest document and asked for by all others
        own = nominated.column("first").to_numpy() == nominated.column("low").to_numpy()
        words = np.full(len(wanted), None, dtype=object)
        words[own] = _phrase_words(block, wanted[own])
        asked = [wanted.view(np.int64), np.full(len(wanted), _OF_PHRASE, dtype=np.int32), np.full(len(wanted), key[0].as_py()), nominated.column("low"), nominated.column("high"), pa.array(words.tolist(), pa.string())]
        return pa.concat_tables([windows, pa.table(asked, schema=_SIGHTINGS)])

    return run


def _width(vocabulary: dict) -> int:
    """Characters of a word in an automaton: digits to base 64. One character a word would give a node as many branches as there are words."""
    return max(1, -(-len(vocabulary).bit_length() // 6))


def _as_text(numbers: np.ndarray, width: int) -> str:
    """Numbers as ``width`` digits each, the lowest first and from an alphabet of its own, so that a match begins where a word does."""
    digits = (numbers[:, None] >> (6 * np.arange(width))) & 63
    digits[:, 0] += 64
    return digits.astype(np.uint8).tobytes().decode("ascii")


def _automaton(vocabulary: dict[bytes, int], phrases: list[str]):
    """The phrases as sequences of words; None if no text can have one."""
    split = [tuple(map(vocabulary.get, phrase.encode().split())) for phrase in phrases]
    known = [ids for ids in split if None not in ids]
    if not known:
        return None
    machine, width = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), _width(vocabulary)
    text = _as_text(np.array(known).reshape(-1) + 1, width)
    for i in range(0, len(text), PHRASE * width):
        machine.add_word(text[i : i + PHRASE * width])
    machine.make_automaton()
    return machine


def _hits(block: _Passages, machine) -> np.ndarray:
    """Where phrases begin, by streaming all documents, with a 0 after each, through the automaton."""
    words, width = block.words, _width(block.words.vocabulary)
    stream = np.zeros(len(words.ids) + len(words.sizes), dtype=np.int64)
    back, place = np.zeros(len(stream), dtype=np.int64), np.arange(len(words.ids)) + words.owner()
    stream[place], back[place] = words.ids + 1, np.arange(len(words.ids))
    ends = np.fromiter((end for end, _ in machine.iter(_as_text(stream, width))), dtype=np.int64)
    return back[ends // width] - (PHRASE - 1)


def _spread(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie from one of ``starts`` to before its end."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(steps[:size]) > 0


def _earliest(block: _Passages, near: np.ndarray, confirmed: pa.Table) -> np.ndarray:
    """The smallest document that has each window of ``near``, if it was confirmed; else the largest number."""
    keys, more, first = confirmed.column("key").to_numpy().view(np.uint64), confirmed.column("more").to_numpy(), confirmed.column("first").to_numpy()
    order = np.lexsort((more, keys))
    keys, more, first = keys[order], more[order], first[order]
    all_keys, all_more = block.hashes()
    wanted, extra = all_keys[near], all_more[near]
    at, earliest = np.searchsorted(keys, wanted), np.full(len(wanted), np.iinfo(np.int64).max)
    left = np.arange(len(wanted))
    while len(left):  # once, unless windows share 64 bits
        left = left[at[left] < len(keys)]
        left = left[keys[at[left]] == wanted[left]]
        same = more[at[left]] == extra[left]
        earliest[left[same]] = first[at[left[same]]]
        left = left[~same]
        at[left] += 1
    return earliest


def _removed(block: _Passages, confirmed: pa.Table) -> np.ndarray:
    """Which words of the block go."""
    size = len(block.words.ids)
    of_phrase = pc.equal(confirmed.column("more"), _OF_PHRASE)
    machine = _automaton(block.words.vocabulary, confirmed.filter(of_phrase).column("phrase").to_pylist())
    if machine is None or not len(block.whole):
        return np.zeros(size, dtype=bool)
    hits = _hits(block, machine)
    located = _spread(np.maximum(hits - (block.window - PHRASE), 0), hits + 1, size)[: len(block.whole)]
    near = np.flatnonzero(located & block.whole)
    windows = near[_earliest(block, near, confirmed.filter(pc.invert(of_phrase))) < block.doc[near]]
    return _spread(windows, windows + block.window, size)


def _locate(window: int, schema: pa.Schema):
    def run(key, table, confirmed):
        if not table.num_rows:
            return schema.empty_table()
        block = _Passages(table, window)
        words, rows = block.words, []
        gone = _removed(block, confirmed) if confirmed.num_rows else np.zeros(len(words.ids), dtype=bool)
        for i, doc_id in enumerate(block.ids):
            start, size = int(words.start[i]), int(words.sizes[i])
            kept, out = words.words[start : start + size], gone[start : start + size]
            removed = int(out.sum())
            if removed:
                kept = [w for w, x in zip(kept, out.tolist(), strict=True) if not x]
            text = b" ".join(kept)
            rows.append((doc_id, size, removed, hashlib.sha256(text).hexdigest(), text))
        columns = list(zip(*rows, strict=True))
        return pa.table([pa.array(columns[schema.names.index(n)] if n != "kept_text" else [x.decode() for x in columns[4]], t) for n, t in zip(schema.names, schema.types, strict=True)], schema=schema)

    return run


def _recurring(sightings: DataFrame) -> DataFrame:
    """Sightings of keys that two documents have: adds ``first``, the smallest, and spells out phrases. A key has at most one row per block."""
    same = Window.partitionBy("key", "more")
    found = sightings.withColumns({"first": F.min("low").over(same), "last": F.max("high").over(same), "phrase": F.max("phrase").over(same)})
    return found.where("first < last")


def remove_repeated_passages(docs: DataFrame, *, window: int = 50, with_text: bool = False) -> DataFrame:
    """Words of each document outside passages that an earlier document has.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: the words that
    stay, unchanged, joined by one space. A word goes if some window of ``window`` consecutive
    words covers it whose word sequence also starts in a document with a smaller doc_id. Windows
    are those of the input; repeats inside one document stay.

    Null text has no words and gives the digest of an empty text; so do empty texts. Texts shorter
    than a window lose nothing. Rows that repeat a doc_id are one document to each other. A row
    with a null doc_id neither loses words nor makes others lose any. An empty table gives an
    empty result. Columns beside doc_id and text are not read. Phrases are matched word for word,
    the rest of a window by an 80-bit hash of its words.
    """
    if window < PHRASE:
        raise ValueError(f"window must be at least {PHRASE}")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(FEWEST_BLOCKS, -(-total // BLOCK_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    # as many partitions as blocks ask for, not as the session has, so that a task's share does not grow with the input
    dealt = dealt.repartition(-(-blocks // 2), "block")
    sightings = "key long, more int, block long, low long, high long, phrase string"
    nominated = _recurring(dealt.groupBy("block").applyInArrow(_nominate(window), sightings)).select("block", "key", "first", "low", "high")
    confirmed = _recurring(dealt.groupBy("block").cogroup(nominated.groupBy("block")).applyInArrow(_confirm(window), sightings))
    confirmed = confirmed.where("first < high").select("block", "key", "more", "first", "phrase")
    fields = [("doc_id", pa.int64(), "long"), ("n_words", pa.int64(), "long"), ("n_removed", pa.int64(), "long"), ("kept_sha256", pa.string(), "string")]
    fields += [("kept_text", pa.string(), "string")] if with_text else []
    schema = pa.schema([(n, t) for n, t, _ in fields])
    return dealt.groupBy("block").cogroup(confirmed.groupBy("block")).applyInArrow(_locate(window, schema), ", ".join(f"{n} {t}" for n, _, t in fields))
