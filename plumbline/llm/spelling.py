"""Grouping of spelling variants by the full neighbourhood of every word.

Every word sends out all strings that one deletion, replacement or insertion over the observed
alphabet makes of it, each once. Those that are words are its near words, as an equi-join with the
vocabulary on the string itself tells, so no distance is ever computed.

A word of n letters has about 2 * n * alphabet such strings, nearly all of which are no words.
They are first made as hashes only (an edit changes a polynomial hash by prefix sums) and looked up
in a bitmap of the vocabulary, whose size is bounded; the few that may be words are spelled and
joined. A bitmap that is too small for a vocabulary lets more strings through and loses none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.storage import bits_of, cut_lineage
from plumbline.llm.words import as_bytes, mixed

#: One occurrence of a run in this many loses a letter, in the mean.
TYPO_EVERY = 97
SHORTEST, FEWEST = 5, 3
#: A form has at least this many times the occurrences of its variant.
FORM_FACTOR = 2
#: Different runs that a task counts before it sends its counts on.
COUNTED = 300_000
#: The bitmap has 2**BITMAP_BITS bits at most (32 MB), and this many per word below that.
BITMAP_BITS, BITS_PER_WORD = 28, 64
#: Strings that are hashed at a time.
HASHED = 1 << 21

#: Runs of letters A-Z and U+00C0 to U+00FF in UTF-8, once A-Z are lower-cased.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_P = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_P, -1, 1 << 64))


def _without_letter(run: bytes, at: int) -> bytes:
    text = run.decode()
    at %= len(text)
    return (text[:at] + text[at + 1 :]).encode()


def run_counts(docs: DataFrame, *, typo_every: int = TYPO_EVERY, shortest: int = SHORTEST) -> DataFrame:
    """(word string, n long): how often each run of letters occurs, of those with ``shortest`` letters.

    A-Z are lower-cased. If ``typo_every`` divides the CRC-32 of ``<doc_id>:<run>``, the run loses
    the letter that the CRC-32 points at, in all its occurrences in that document.
    """

    def counted(counts: Counter) -> pa.RecordBatch:
        words = [w for w in counts if len(w) >= shortest and len(w.decode()) >= shortest]
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(as_bytes(batch.column("doc_id")), as_bytes(batch.column("text")), strict=True):
                if not text:
                    continue
                seed, own = zlib.crc32(doc_id + b":"), Counter(_RUN.findall(text.lower()))
                typos = [(w, h) for w in own if (h := zlib.crc32(w, seed)) % typo_every == 0]
                typos = [(_without_letter(w, h), own.pop(w)) for w, h in typos]
                counts.update(own)
                for word, n in typos:
                    counts[word] += n
                if len(counts) >= COUNTED:
                    yield counted(counts)
                    counts = Counter()
        yield counted(counts)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of code points."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _powers(n: int) -> np.ndarray:
    found = np.full(n, _P, dtype=np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


def _by_length(words: list[str], each: int) -> Iterator[list[str]]:
    """Words of equal length together, so many that they have about HASHED strings of ``each`` for a letter."""
    lengths: dict[int, list[str]] = {}
    for w in words:
        lengths.setdefault(len(w), []).append(w)
    for n, own in lengths.items():
        step = max(1, HASHED // max(1, n * each))
        for start in range(0, len(own), step):
            yield own[start : start + step]


def word_hashes(words: list[str]) -> tuple[list[str], np.ndarray]:
    """The words, in order of their lengths, and their hashes."""
    found, hashes = [], [np.zeros(0, dtype=np.uint64)]
    for own in _by_length(words, 1):
        codes = _codes(own)
        found += own
        hashes.append(mixed((codes * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)))
    return found, np.concatenate(hashes)


def neighbour_hashes(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Hashes of all strings one edit away from words of one length: (kind, first place, hashes, which of them count).

    ``hashes`` is (words, places) for deletions and (words, places, alphabet) otherwise. Of edits
    that make the same string one counts: a letter goes, or comes, at the first place of a run of
    equal letters, and none is replaced by itself.
    """
    count, n = codes.shape
    powers = _powers(n + 1)
    sums = np.zeros((count, n + 1), dtype=np.uint64)
    np.cumsum(codes * powers[:n], axis=1, out=sums[:, 1:])
    whole = sums[:, n:]
    differs = np.ones((count, n), dtype=bool)
    differs[:, 1:] = codes[:, 1:] != codes[:, :-1]
    yield "delete", 0, mixed(sums[:, :n] + (whole - sums[:, 1:]) * _BACK), differs
    step = max(1, HASHED // (count * len(alphabet)))
    for at in range(0, n + 1, step):
        end = min(n, at + step)
        if end > at:
            own = codes[:, at:end, None]
            yield "replace", at, mixed(whole[:, :, None] + (alphabet - own) * powers[at:end, None]), own != alphabet
        end = min(n + 1, at + step)
        left = np.zeros((count, end - at), dtype=np.uint64)
        left[:, max(0, 1 - at) :] = codes[:, max(at, 1) - 1 : end - 1]
        hashes = mixed((sums[:, at:end] + (whole - sums[:, at:end]) * np.uint64(_P))[:, :, None] + alphabet * powers[at:end, None])
        yield "insert", at, hashes, left[:, :, None] != alphabet


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the bitmap that a hash stands for."""
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _spelled(words: list[str], kind: str, at: int, hits: tuple[np.ndarray, ...], alphabet: str) -> Iterator[tuple[str, str]]:
    if kind == "delete":
        for w, i in zip(*(h.tolist() for h in hits), strict=True):
            yield words[w], words[w][:i] + words[w][i + 1 :]
    else:
        skip = int(kind == "replace")
        for w, i, c in zip(*(h.tolist() for h in hits), strict=True):
            yield words[w], words[w][: at + i] + alphabet[c] + words[w][at + i + skip :]


def _bitmap(vocabulary: DataFrame, bits: int) -> np.ndarray:
    """The bits of all words; 2**bits bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = word_hashes(batch.column("word").to_pylist())[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_probes(hashes, bits)).astype(np.int64))], ["bit"])

    return bits_of(vocabulary.select("word").mapInArrow(run, "bit long"), bits)


def near_words(vocabulary: DataFrame, size: int, *, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """(word, near, near_n): every word of ``vocabulary`` (word, n; ``size`` rows) with each of its near words."""
    bits = min(bitmap_bits, max(15, math.ceil(math.log2(max(1, size) * BITS_PER_WORD))))
    letters = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().where("c <> ''")
    alphabet = "".join(sorted(r.c for r in letters.collect()))  # at most the 89 letters that a run can have
    shared = vocabulary.sparkSession.sparkContext.broadcast(_bitmap(vocabulary, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = shared.value, np.array([*map(ord, alphabet)], dtype=np.uint64)
        for batch in batches:
            for own in _by_length(batch.column("word").to_pylist(), len(alphabet)):
                found: list[tuple[str, str]] = []
                for kind, at, hashes, counts in neighbour_hashes(_codes(own), codes):
                    for probe in _probes(hashes, bits):
                        counts &= (known[probe >> np.uint64(3)] >> (probe & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    found += _spelled(own, kind, at, np.nonzero(counts), alphabet)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], ["word", "near"])

    candidates = vocabulary.select("word").mapInArrow(run, "word string, near string")
    return candidates.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of every row of ``forms`` (word, form), where no path has more than ``most`` steps, by doubling the steps."""
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(1, most)))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = cut_lineage(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return roots


def spelling_variants(docs: DataFrame, *, typo_every: int = TYPO_EVERY, shortest: int = SHORTEST, fewest: int = FEWEST, factor: int = FORM_FACTOR, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of ``run_counts`` with ``fewest`` occurrences. Two are near if one inserted,
    deleted or replaced letter is the difference. The form is the near word of largest n, of equal
    ones the first by code points, if its n is at least ``factor`` times the word's (which must be
    over 1); else null. The root is where the forms lead to in the end, the word itself if it has
    none. As n grows by the factor with each step, the number of steps is known from the largest n.

    Null texts have no words; null doc_ids count as empty; repeated rows count each; an empty table
    or one without words gives no row. Very long runs are words like others. Columns beside doc_id
    and text are not read.
    """
    counts = run_counts(docs, typo_every=typo_every, shortest=shortest)
    vocabulary = cut_lineage(counts.where(F.col("n") >= fewest))
    size, most = vocabulary.agg(F.count(F.lit(1)), F.max("n")).first()
    near = near_words(vocabulary, size, bitmap_bits=bitmap_bits)
    order = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(order).alias("best"))
    best_n = -F.col("best.less")
    formed = cut_lineage(
        vocabulary.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(best_n >= factor * F.col("n"), F.col("best.near")).alias("form"), F.when(best_n >= factor * F.col("n"), best_n).alias("form_n"),
        )
    )
    steps = math.ceil(math.log(max(1, (most or 1) / fewest), factor)) + 1
    roots = _roots(formed.where("form IS NOT NULL"), steps)
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
