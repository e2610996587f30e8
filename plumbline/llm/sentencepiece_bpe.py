"""SentencePiece BPE encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.words import mixed

#: A model file of merge type with byte fallback.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Share of candidate merges that are skipped.
DROPOUT = 0.1
#: Units, and characters of units, that a task remembers.
REMEMBERED, REMEMBERED_CHARS = 100_000, 2_000_000
#: Bytes of text that are encoded together, about; a longer document goes alone.
LOT_BYTES = 1 << 19
#: Characters of the units whose agendas are worked off side by side, by the width of their table; longer ones go one by one.
WIDTHS = (4, 8, 16, 32, 64)
#: Cells of a table of agendas.
CELLS = 1 << 16

_MARK = "▁"
_MASK = (1 << 64) - 1
#: The place in the order of scores of a pair that makes no piece.
_NONE = np.int32(1 << 30)
_PAIR = 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Pieces:
    """A merge-type vocabulary: the symbol of each character, the piece that two symbols make, and the order of the pieces by score, the best first."""

    chars: dict[str, int]
    pairs: dict[int, int]
    order: np.ndarray
    byte_ids: tuple[int, ...]
    output: tuple[bytes, ...]
    units: str


def load_pieces(path: str = MODEL_PATH) -> Pieces:
    """Read a model file on the driver; the result is small (a vocabulary) and goes to the tasks by broadcast."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, byte_ids, output, glue = {}, [0] * 256, [], set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            output.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            output.append(b"")
        else:
            if _MARK in piece.lstrip(_MARK) or "\n" in piece:
                raise ValueError(f"piece {piece!r} spans units; this model is not supported")
            ids[piece] = i
            output.append(piece.replace(_MARK, " ").encode())
            glue.update(a for a, b in zip(piece, piece[1:], strict=False) if a.isalnum() and not b.isalnum())
    if output[0] or any(c not in ids for piece in ids for c in piece):
        raise ValueError("a piece has id 0 or a character that is no piece; this model is not supported")
    scores = {score: place for place, score in enumerate(sorted({-model.get_score(i) for i in ids.values()}))}
    order = np.full(len(output), _NONE)
    for i in ids.values():
        order[i] = scores[-model.get_score(i)]
    halves = ((piece[:k], piece[k:], i) for piece, i in ids.items() for k in range(1, len(piece)))
    pairs = {ids[a] << _PAIR | ids[b]: i for a, b, i in halves if a in ids and b in ids}
    return Pieces({c: i for c, i in ids.items() if len(c) == 1}, pairs, order, tuple(byte_ids), tuple(output), _units("".join(sorted(glue))))


def _units(glue: str) -> str:
    """The pattern of the units of text that merges stay inside of.

    No piece has a space mark after another character, or a line feed; and none has a letter or
    digit before another kind of character, except the few in ``glue``.
    """
    some, word = (f"(?![{re.escape(glue)}])", f"[^\\W_{re.escape(glue)}]") if glue else ("", r"[^\W_]")
    return rf" *{word}++{some}| *[^ \n]+| +|\n"


class _Numbers(dict):
    """Units to consecutive numbers; ``fresh`` has those that are new since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        found = self[unit] = len(self)
        self.fresh.append(unit)
        return found


class _Column:
    """A one-dimensional array that grows."""

    def __init__(self, kind):
        self.data, self.size = np.zeros(1 << 12, dtype=kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.size + len(values) > len(self.data):
            grown = np.zeros(max(2 * len(self.data), self.size + len(values)), dtype=self.data.dtype)
            grown[: self.size] = self.data[: self.size]
            self.data = grown
        self.data[self.size : self.size + len(values)] = values
        self.size += len(values)


def _starts(sizes: np.ndarray) -> np.ndarray:
    """Where each of consecutive runs begins."""
    return np.cumsum(sizes) - sizes


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` one after another."""
    return pool[np.arange(int(sizes.sum())) + np.repeat(starts - _starts(sizes), sizes)]


class Encoder:
    """Encodes texts with a vocabulary, a seed and a share of skipped merges.

    A unit's agenda holds the candidate of each pair of neighbours. The one with the best score,
    the leftmost on ties, comes up next; it is skipped, and does not come back, or its parts merge
    and give new candidates. Which ones are skipped is drawn for each occurrence of a unit by
    hashes of seed, doc_id, place and number of the skip: each hash gives the candidates up to the
    next skip, so that an occurrence whose first skip lies beyond the merges of its unit costs one
    comparison and takes the remembered segmentation.
    """

    def __init__(self, pieces: Pieces, *, dropout: float = DROPOUT, seed: int = 42):
        self.pieces, self.seed, self.dropout = pieces, seed, dropout
        with np.errstate(divide="ignore"):
            self.log_kept = np.log1p(-float(dropout))
        self.units = re.compile(pieces.units)
        self.symbols = -1 - np.arange(0x110000, dtype=np.int32)
        for char, symbol in pieces.chars.items():
            self.symbols[ord(char)] = symbol
        self.symbols[ord(" ")] = pieces.chars[_MARK]
        self.byte_ids = np.array(pieces.byte_ids, dtype=np.int32)
        # a piece whose score no other one has is told by its place in the order
        places, first, count = np.unique(pieces.order, return_index=True, return_counts=True)
        self.of_place = np.zeros(int(places[places < _NONE].max(initial=0)) + 1, dtype=np.int32)
        alone = (count == 1) & (places < _NONE)
        self.of_place[places[alone]] = first[alone]
        # open addressing with at most a quarter of the slots taken
        self.bits = max(4, (4 * len(pieces.pairs)).bit_length())
        self.slot_pairs, self.slot_ids = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        pairs = np.fromiter(pieces.pairs, dtype=np.int64, count=len(pieces.pairs))
        for pair, slot, made in zip(pairs.tolist(), self._slots(pairs).tolist(), pieces.pairs.values(), strict=True):
            while self.slot_pairs[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.slot_pairs[slot], self.slot_ids[slot] = pair, made
        self._forget()

    def _forget(self) -> None:
        self.known, self.long = _Numbers(), {}
        self.chars, self.plain = _Column(np.int32), _Column(np.int32)
        self.char_start, self.char_size, self.plain_start, self.plain_size, self.merges = (_Column(np.int64) for _ in range(5))

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def _made(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, 0 for none."""
        pairs = np.maximum(a, 0).astype(np.int64) << _PAIR | np.maximum(b, 0)
        slots = self._slots(pairs)
        there = self.slot_pairs[slots]
        same = there == pairs
        made = np.where(same, self.slot_ids[slots], np.int32(0))
        left = np.flatnonzero(~same & (there >= 0))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            there = self.slot_pairs[slots[left]]
            same = there == pairs[left]
            made[left[same]] = self.slot_ids[slots[left[same]]]
            left = left[~same & (there >= 0)]
        return made

    def _gaps(self, keys: np.ndarray, turn: np.ndarray | int) -> np.ndarray:
        """Candidates that merge before the next skip, for the number of the skip of each occurrence."""
        drawn = mixed(keys + np.asarray(turn).astype(np.uint64) * _TURN)
        drawn ^= drawn >> np.uint64(32)
        chance = ((drawn >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53
        return np.minimum(np.log(chance) / self.log_kept, 1e9).astype(np.int64)

    def skipped(self, key: int) -> Iterator[int]:
        """The numbers of the skipped candidates of one occurrence, without end."""
        turn, at = 0, -1
        while True:
            at += 1 + int(self._gaps(np.array([key], dtype=np.uint64), turn)[0])
            yield at
            turn += 1

    def occurrence_keys(self, doc_id: int | None, places: np.ndarray) -> np.ndarray:
        """What the draws of a document's units hang on."""
        start = xxhash.xxh3_64_intdigest(b"%d" % (doc_id or 0), self.seed & _MASK)
        return mixed(places.astype(np.uint64) * _SPREAD + np.uint64(start))

    def _agendas(self, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Work off the agendas of units of at most the last of WIDTHS characters: ids, where each unit's begin and how many, and its merges."""
        found, begin, count, merges, total = [np.zeros(0, dtype=np.int32)], np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64), 0
        least = 0
        for width in WIDTHS:
            of_width = np.flatnonzero((sizes > least) & (sizes <= width))
            least = width
            for rows in (of_width[i : i + CELLS // width] for i in range(0, len(of_width), CELLS // width)):
                symbols = self._table(starts[rows], sizes[rows], width, None if keys is None else keys[rows])
                there = symbols != 0
                merges[rows] = sizes[rows] - there.sum(axis=1)
                ids, count[rows] = self._written(symbols[there], there.sum(axis=1))
                begin[rows] = total + _starts(count[rows])
                total += len(ids)
                found.append(ids)
        return np.concatenate(found), begin, count, merges

    def _table(self, starts: np.ndarray, sizes: np.ndarray, width: int, keys: np.ndarray | None) -> np.ndarray:
        """Symbols of each unit once no candidate is left, 0 where one was merged into its left neighbour.

        All rows take one candidate at a time, so the number of the candidate is the same for all.
        A column without a symbol on either side spares the tests for the ends.
        """
        order, stride, n = self.pieces.order, width + 2, len(starts)
        inside = np.arange(width) < sizes[:, None]
        symbols = np.zeros((n, stride), dtype=np.int32)
        symbols[:, 1:-1][inside] = _gather(self.chars.data, starts, sizes)
        agenda = np.full((n, stride), _NONE)
        pairs = inside[:, 1:]
        agenda[:, 1:-2][pairs] = order[self._made(symbols[:, 1:-2][pairs], symbols[:, 2:-1][pairs])]
        after = np.tile(np.arange(1, stride + 1), (n, 1))
        before = after - 2
        cells, ranks, afters, befores = symbols.reshape(-1), agenda.reshape(-1), after.reshape(-1), before.reshape(-1)
        rows = np.arange(n)
        if keys is not None:
            turn, skip = np.zeros(n, dtype=np.int64), self._gaps(keys, 0)
        number = 0
        while len(rows):
            open_ = agenda[rows]
            at = open_.argmin(axis=1)
            best = open_[np.arange(len(rows)), at]
            live = best < _NONE
            if not live.all():
                rows, at, best = rows[live], at[live], best[live]
            base = rows * stride
            if keys is not None:
                out = skip[rows] == number
                if out.any():
                    gone = rows[out]
                    ranks[base[out] + at[out]] = _NONE
                    turn[gone] += 1
                    skip[gone] = number + 1 + self._gaps(keys[gone], turn[gone])
                    stay = ~out
                    base, at, best = base[stay], at[stay], best[stay]
            left = base + at
            next_ = afters[left]
            right = base + next_
            made = self.of_place[best]
            tied = np.flatnonzero(made == 0)
            if len(tied):
                made[tied] = self._made(cells[left[tied]], cells[right[tied]])
            beyond, ahead = afters[right], base + befores[left]
            cells[left], cells[right], ranks[right], afters[left] = made, 0, _NONE, beyond
            beyond = base + beyond
            befores[beyond] = at
            ranks[left] = order[self._made(made, cells[beyond])]
            ranks[ahead] = order[self._made(cells[ahead], made)]
            number += 1
        return symbols[:, 1:-1]

    def _written(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols in runs of ``sizes``: characters without a piece become the ids of their bytes."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols, sizes
        codes = -1 - symbols[odd]
        lengths = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        repeats = np.ones(len(symbols), dtype=np.int64)
        repeats[odd] = lengths
        ids, at = np.repeat(symbols, repeats), _starts(repeats)[odd]
        for length in (1, 2, 3, 4):
            of = lengths == length
            for k in range(length):
                bits = codes[of] >> (6 * (length - 1 - k))
                lead = bits if length == 1 else bits | (0x100 - (0x100 >> length)) & 0xFF if k == 0 else bits & 0x3F | 0x80
                ids[at[of] + k] = self.byte_ids[lead]
        return ids, np.add.reduceat(repeats, _starts(sizes))

    def _long(self, unit: str, key: int | None) -> tuple[np.ndarray, int]:
        """Ids of one unit and its merges: the agenda as a heap over linked symbols; a candidate is stale once one of its parts has changed."""
        pairs, order = self.pieces.pairs.get, self.pieces.order
        symbols = self.symbols[np.frombuffer(unit.encode("utf-32-le"), dtype=np.uint32)].tolist()
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def candidate(left: int, right: int):
            made = pairs(symbols[left] << _PAIR | symbols[right]) if symbols[left] > 0 < symbols[right] else None
            return [] if made is None else [(int(order[made]), left, symbols[left], symbols[right], made)]

        agenda = [c for i in range(n - 1) for c in candidate(i, i + 1)]
        heapq.heapify(agenda)
        skips = self.skipped(key) if key is not None and self.dropout else iter(())
        number, skip, merges = -1, next(skips, -1), 0
        while agenda:
            _, left, own, other, made = heapq.heappop(agenda)
            right = after[left]
            if right >= n or symbols[left] != own or symbols[right] != other:
                continue
            number += 1
            if number == skip:
                skip = next(skips)
                continue
            merges += 1
            symbols[left], symbols[right] = made, 0
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for pair in ((before[left], left), (left, after[left])):
                if pair[0] >= 0 and pair[1] < n:
                    for c in candidate(*pair):
                        heapq.heappush(agenda, c)
        left = np.array([s for s in symbols if s], dtype=np.int32)
        return self._written(left, np.array([len(left)]))[0], merges

    def _learn(self) -> None:
        """Remember the characters and the plain segmentation of each fresh unit."""
        units, self.known.fresh = self.known.fresh, []
        first, size = len(self.char_size.data[: self.char_size.size]), np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        starts = self.chars.size + _starts(size)
        self.chars.add(self.symbols[codes])
        self.char_start.add(starts)
        self.char_size.add(size)
        ids, begin, count, merges = self._agendas(starts, np.where(size > WIDTHS[-1], 0, size), None)
        more = [ids]
        for i in np.flatnonzero(size > WIDTHS[-1]).tolist():
            self.long[first + i] = units[i]
            ids, merges[i] = self._long(units[i], None)
            begin[i], count[i] = sum(map(len, more)), len(ids)
            more.append(ids)
        if _MARK in units:  # a space mark in the text itself is written byte by byte, so that decoding gives it back
            i, ids = units.index(_MARK), self.byte_ids[list(_MARK.encode())]
            begin[i], count[i], merges[i] = sum(map(len, more)), len(ids), 0
            more.append(ids)
        self.plain_start.add(self.plain.size + begin)
        self.plain_size.add(count)
        self.merges.add(merges)
        self.plain.add(np.concatenate(more))

    def encode_lot(self, texts: list[str | None], doc_ids: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, and where each text's begin, with the total at the end; null and empty texts have none."""
        if len(self.known) > REMEMBERED or self.chars.size > REMEMBERED_CHARS:
            self._forget()
        numbers, sizes, keys = [np.zeros(0, dtype=np.int64)], [], []
        for text, doc_id in zip(texts, doc_ids, strict=True):
            units = []  # of one text only: beside those of a whole lot, the few that are remembered would keep all their memory
            for i, part in enumerate(text.split(_MARK) if text else ()):
                units += [_MARK] * bool(i)
                units += self.units.findall(part if i else " " + part)
            sizes.append(len(units))
            numbers.append(np.fromiter(map(self.known.__getitem__, units), dtype=np.int64, count=len(units)))
            if self.dropout:
                keys.append(self.occurrence_keys(doc_id, np.arange(len(units))))
        numbers = np.concatenate(numbers)
        if self.known.fresh:
            self._learn()
        begin, count, pool = self.plain_start.data[numbers], self.plain_size.data[numbers], self.plain.data[: self.plain.size]
        if self.dropout and len(numbers):
            keys = np.concatenate(keys)
            touched = np.flatnonzero(self._gaps(keys, 0) < self.merges.data[numbers])
            size = self.char_size.data[numbers[touched]]
            ids, at, many, _ = self._agendas(self.char_start.data[numbers[touched]], np.where(size > WIDTHS[-1], 0, size), keys[touched])
            more, total = [pool, ids], len(ids)
            for i in np.flatnonzero(size > WIDTHS[-1]).tolist():
                ids, _ = self._long(self.long[int(numbers[touched[i]])], int(keys[touched[i]]))
                at[i], many[i] = total, len(ids)
                total += len(ids)
                more.append(ids)
            begin[touched], count[touched] = len(pool) + at, many
            pool = np.concatenate(more)
        ends = np.concatenate(([0], np.cumsum(count)))
        return _gather(pool, begin, count), ends[np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))]

    def encode(self, text: str, doc_id: int | None = 0) -> list[int]:
        """Ids of a whole text; an empty one has none."""
        return self.encode_lot([text], [doc_id])[0].tolist()

    def decode(self, ids) -> str:
        """The text of ids from ``encode``: exactly the text that was encoded."""
        return b"".join(map(self.pieces.output.__getitem__, ids))[1:].decode("utf-8", "replace")


def _encoder(docs: DataFrame, path: str, dropout: float, seed: int):
    """Makes the encoder of a task. It goes with the task: a Python worker lives on, and later stages would carry what it remembers."""
    shared = docs.sparkSession.sparkContext.broadcast(load_pieces(path))
    return lambda: Encoder(shared.value, dropout=dropout, seed=seed)


def _lots(batches):
    """Rows of about LOT_BYTES of text at a time, so that a task holds few ids."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LOT_BYTES, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def encode_documents(docs: DataFrame, *, path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = 42) -> DataFrame:
    """One row per document: doc_id and ``ids``, an array of int.

    Without dropout the ids are those of the SentencePiece library, but for the space mark U+2581
    in a text, which the library turns into a space and this encoder keeps, byte by byte. With
    dropout, each occurrence of a unit (a word with the spaces before it) draws which of its
    candidate merges are skipped by hashes of seed, doc_id and place, so that reruns agree. Null
    text gives null, empty text an empty array; a null doc_id draws as 0. Repeated rows each give
    a row; an empty table gives an empty result. Columns beside doc_id and text are not read.
    """
    make = _encoder(docs, path, dropout, seed)

    def run(batches):
        encoder = make()
        for lot in _lots(batches):
            ids, starts = encoder.encode_lot(lot.column("text").to_pylist(), lot.column("doc_id").to_pylist())
            found = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids), mask=lot.column("text").is_null())
            yield pa.RecordBatch.from_arrays([lot.column("doc_id"), found], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, *, path: str = MODEL_PATH) -> DataFrame:
    """doc_id and ``text`` of rows of doc_id and ids; null ids give null text."""
    output = encoded.sparkSession.sparkContext.broadcast(load_pieces(path).output)

    def run(batches):
        pieces = output.value
        for batch in batches:
            texts = [None if ids is None else b"".join(map(pieces.__getitem__, ids))[1:].decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def encoding_digest(docs: DataFrame, *, path: str = MODEL_PATH, dropout: float = DROPOUT, seed: int = 42) -> DataFrame:
    """doc_id, n_ids, ids_sha256 (of the ids as little-endian 32-bit integers) and lossless, whether decoding gives the text back.

    One pass encodes and decodes, so the ids need not be stored. Null text: no ids, lossless null.
    """
    make = _encoder(docs, path, dropout, seed)

    def run(batches):
        encoder = make()
        for lot in _lots(batches):
            doc_ids, texts = lot.column("doc_id").to_pylist(), lot.column("text").to_pylist()
            ids, starts = encoder.encode_lot(texts, doc_ids)
            bounds = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
            digests = [hashlib.sha256(ids[a:b].astype("<i4", copy=False)).hexdigest() for a, b in bounds]
            lossless = [None if text is None else encoder.decode(ids[a:b].tolist()) == text for (a, b), text in zip(bounds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([lot.column("doc_id"), pa.array(np.diff(starts)), pa.array(digests, pa.string()), pa.array(lossless, pa.bool_())], ["doc_id", "n_ids", "ids_sha256", "lossless"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, lossless boolean")
