"""Words of a block of texts as numpy arrays, and rolling hashes over them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Vocabulary(dict):
    """Word bytes to consecutive ids, with a 64-bit hash of each word that does not depend on the process."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def clear(self) -> None:
        super().clear()
        self.hashes = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return found


class WordHashes(dict):
    """Word bytes to a 64-bit hash, as in ``Vocabulary``."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        """The hashes of a text's words in order."""
        words = text.split() if text else []
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Block:
    """The words of several texts one after another: ``ids`` and ``hashes`` by word, ``start`` by text.

    A ``vocabulary`` may come from earlier blocks. ``bytes.split`` splits at exactly the six ASCII white-space characters that bound a word here.
    """

    def __init__(self, texts: list[bytes | None], vocabulary: Vocabulary | None = None):
        self.vocabulary = Vocabulary() if vocabulary is None else vocabulary
        words: list[bytes] = []
        sizes = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                before = len(words)
                words += text.split()
                sizes[i] = len(words) - before
        self.words = words
        self.ids = np.fromiter(map(self.vocabulary.__getitem__, words), dtype=np.int64, count=len(words))
        self.hashes = np.array(self.vocabulary.hashes, dtype=np.uint64)[self.ids] if words else np.zeros(0, dtype=np.uint64)
        self.start = np.concatenate(([0], np.cumsum(sizes)))
        self.sizes = sizes

    def owner(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def whole(self, width: int) -> np.ndarray:
        """Whether a window of ``width`` words that starts at a word ends in the same text."""
        n = len(self.ids) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        return np.arange(n) + width <= np.repeat(self.start[1:], self.sizes)[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` hashes, by prefix sums of a polynomial modulo 2**64."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    powers = np.full(n, _BASE, dtype=np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers, out=sums[1:])
    back = np.full(n - width + 1, _BASE_INVERSE, dtype=np.uint64)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mixed((sums[width:] - sums[:-width]) * back)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.cast(column, kind).to_pylist()


def lots(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows with about ``most`` bytes of text at a time; a longer text comes alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
