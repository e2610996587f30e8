"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.columns import FEW_VALUES, first_by_hash

#: Hashed dimensions of one-, two- and three-character features.
DIMENSIONS = (1 << 10, 1 << 12, 1 << 13)
#: Centroids per language.
CENTROIDS = 4
#: Labelled documents per language that a fit reads, at most, taken in the order of a hash of doc_id.
SAMPLE = 300
#: Labelled documents that a fit reads in all; beyond SAMPLE_TOTAL / SAMPLE languages each gives fewer, and none is left out.
SAMPLE_TOTAL = 15_000
#: Characters of a sampled document that a fit reads, at most, from a place that a hash of doc_id gives.
SAMPLE_CHARS = 8192
#: Every so manieth sampled document sets the rejection bounds and takes no part in the centroids.
CALIBRATION = 4
#: Words of the pieces of these documents that stand for shorter texts.
PIECES = (1, 2, 4, 8, 16, 32, 64, 128, 256, 512)
#: A text is rejected if its similarity is below this share of the 5 % quantile of pieces with about as many different
#: terms in its language. Fewer than one piece in a thousand of the languages themselves lies below it.
REJECT_SHARE = 0.6
#: Pieces that each point of a bound is drawn from, at least.
POINT = 24

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
_SPACE = np.uint32(32)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points; ASCII characters that are no letters become spaces, runs of spaces one."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32).copy()
    codes[(codes < 97) | ((codes > 122) & (codes < 128))] = _SPACE
    return codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]


def term_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of a whole text."""
    codes = _codes(text)
    parts, total = [], np.zeros(len(codes), dtype=np.uint32)
    for n, (size, multiplier) in enumerate(zip(DIMENSIONS, _MULTIPLIERS, strict=True)):
        total = (total[: len(codes) - n] ^ codes[n:]) * multiplier
        spread = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        parts.append(np.bincount((spread >> np.uint32(16)) & np.uint32(size - 1), minlength=size))
    return np.concatenate(parts)


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter of any script."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Centroids:
    """A fitted model: one row of ``matrix`` per centroid, its language, and for each language the least similarity by the base-2 logarithm of the number of different terms."""

    matrix: np.ndarray
    languages: list[str]
    idf: np.ndarray
    bounds: dict[str, tuple[np.ndarray, np.ndarray]]

    def nearest(self, text: str) -> tuple[str, float, float]:
        """Language and cosine similarity of the nearest centroid, and the logarithm of the number of different terms."""
        counts = term_counts(text)
        weights = np.log1p(counts).astype(np.float32) * self.idf
        norm = float(np.sqrt(weights @ weights))
        near = self.matrix @ (weights / norm if norm else weights)
        best = int(near.argmax())
        return self.languages[best], min(1.0, max(0.0, float(near[best]))), float(np.log2(max(1, np.count_nonzero(counts))))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine similarity of the nearest centroid, and whether the document is rejected: its distance is beyond what texts of as many terms have."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        language, score, terms = self.nearest(text)
        points = self.bounds.get(language)
        return language, score, bool(points) and score < float(np.interp(terms, *points))


def rejection_bounds(model: Centroids, rows: list[tuple[str, str]]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Bounds from (language, text) that the centroids were not fitted on.

    Texts and pieces of them, as far as they fall to their own language, are sorted by their
    number of different terms and cut into groups of POINT or more; each gives a point. Languages
    with pieces for fewer than eight points share those of all languages.
    """
    seen: dict[str, list[tuple[float, float]]] = {}
    for turn, (lang, text) in enumerate(rows):
        words = text.split()
        pieces = [" ".join(words[start : start + n]) for n in PIECES if n < len(words) for start in [turn * 7919 % (len(words) - n + 1)]]
        for piece in [text, *pieces]:
            if has_letter(piece):
                found, score, terms = model.nearest(piece)
                if found == lang:
                    seen.setdefault(lang, []).append((terms, score))
    everything, bounds = [p for points in seen.values() for p in points], {}
    for lang in set(model.languages) if everything else ():
        points = seen.get(lang, [])
        points = points if len(points) >= 8 * POINT else everything
        parts = np.array_split(np.array(sorted(points)), max(1, len(points) // POINT))
        bounds[lang] = (np.array([float(np.median(p[:, 0])) for p in parts]), np.array([REJECT_SHARE * float(np.quantile(p[:, 1], 0.05)) for p in parts]))
    return bounds


def _cluster(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from the farthest-first start."""
    chosen = [0]
    closest = vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(closest.argmin()))
        closest = np.maximum(closest, vectors @ vectors[chosen[-1]])
    centers = vectors[chosen]
    for _ in range(rounds):
        own = (vectors @ centers.T).argmax(axis=1)
        for k in range(len(centers)):
            if (own == k).any():
                mean = vectors[own == k].sum(axis=0)
                centers[k] = mean / (np.linalg.norm(mean) or 1.0)
    return centers


def fit_texts(rows: list[tuple[str, str]], *, centroids: int = CENTROIDS) -> Centroids:
    """Fit on (language, text); texts without a letter are passed over."""
    rows = sorted(r for r in rows if has_letter(r[1]))
    turn: dict[str, int] = {}
    kept, calibration = [], []
    for lang, text in rows:
        turn[lang] = turn.get(lang, 0) + 1
        (calibration if turn[lang] % CALIBRATION == 0 else kept).append((lang, text))
    counted = [(lang, term_counts(text)) for lang, text in kept]
    size = sum(DIMENSIONS)
    idf = np.log((1 + len(counted)) / (1 + sum(((c > 0) for _, c in counted), np.zeros(size)))) + 1
    matrix, languages = [np.zeros((0, size), dtype=np.float32)], []
    for language in sorted(turn):
        vectors = np.array([np.log1p(c) * idf for lang, c in counted if lang == language], dtype=np.float32)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        centers = _cluster(vectors, centroids)
        matrix.append(centers)
        languages += [language] * len(centers)
    model = Centroids(np.concatenate(matrix), languages, idf.astype(np.float32), {})
    return replace(model, bounds=rejection_bounds(model, calibration))


def fit_centroids(labelled: DataFrame, *, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Fit on up to ``sample`` documents of every language, SAMPLE_TOTAL in all or 2 of each if that is more; rows without doc_id, text or lang are passed over.

    The ids are chosen from doc_id and lang alone, then one more scan fetches SAMPLE_CHARS
    characters of each by a join with the ids, which are broadcast for up to FEW_VALUES languages. Of rows with the same doc_id one counts.
    """
    known = labelled.where("doc_id IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang")
    languages = known.select("lang").distinct().count()
    ids = first_by_hash(known, "lang", max(2, min(sample, SAMPLE_TOTAL // max(1, languages))), most=None).select("doc_id").distinct()
    rows = labelled.join(F.broadcast(ids) if languages <= FEW_VALUES else ids, "doc_id").where("text IS NOT NULL AND lang IS NOT NULL")
    start = F.lit(1) + F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - F.lit(SAMPLE_CHARS - 1)))
    rows = rows.select("doc_id", F.struct("lang", F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")).alias("row")).groupBy("doc_id").agg(F.min("row").alias("row"))
    return fit_texts([(r.row.lang, r.row.text) for r in rows.collect()], centroids=centroids)


def predict_languages(docs: DataFrame, model: Centroids) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, rejected.

    lang_pred is the language of the nearest centroid by cosine of the whole text's TF-IDF
    vector, and ``und`` with score 0 for null text, text without a letter, or a model fitted on no
    documents. ``rejected`` marks those and documents too far from every centroid. Ties go to the
    language that is first in code-point order. Repeated rows each give a row; an empty table
    gives an empty result. Columns beside doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            found = [fitted.predict(text) for text in batch.column("text").to_pylist()]
            languages, scores, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id="doc_id"):
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame, model: Centroids) -> DataFrame:
    """The rows of ``docs`` whose language the model accepts, with all their columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        fitted = shared.value
        for batch in batches:
            accepted = [not fitted.predict(text)[2] for text in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
