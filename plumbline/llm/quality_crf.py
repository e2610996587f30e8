"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.columns import first_by_hash
from plumbline.llm.words import Vocabulary, as_bytes

#: Labelled documents of each class that a fit reads, at most, taken in the order of a hash of doc_id.
SAMPLE = 300
#: Lines of a document that a fit reads, at most.
LINES = 100
#: A document is kept if at least this share of its words is in lines labelled content.
CONTENT_SHARE = 0.5
#: Texts are counted in groups of about this many bytes, each with its own word numbers.
GROUP_BYTES = 4 << 20

_SPACES = b" \t\n\v\f\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_SHOUTS = b"!?"
_CONTINUES = bytes(range(0x80, 0xC0))
FEATURES = ("bias", "shout", "symbols", "digits", "upper", "repeats", "duplicate", "short", "long_words", "no_stop")


def _without(text: bytes, chars: bytes) -> int:
    """How many bytes of ``text`` are among ``chars``."""
    return len(text) - len(text.translate(None, chars))


def line_features(line: bytes, words: list[bytes], duplicate: bool) -> tuple[float, ...]:
    """Shares that describe one line with at least one word, in the order of FEATURES."""
    size, count = max(1, len(line)), len(words)
    upper, lower = _without(line, _UPPER), _without(line, _LOWER)
    return (
        1.0,
        min(1.0, _without(line, _SHOUTS) / count),
        min(1.0, _without(line, _SYMBOLS) / count),
        _without(line, _DIGITS) / size,
        upper / max(1, upper + lower),
        1.0 - len(set(words)) / count,
        float(duplicate),
        1.0 if count < 4 else 0.0,
        min(1.0, max(0.0, size / count - 9.0) / 10.0),
        0.0 if line.rstrip().endswith((b".", b"!", b"?", b":", b'"')) else 1.0,
    )


@dataclass(frozen=True)
class LineModel:
    """Weights of the boilerplate label against content, and the scores of staying or changing between lines."""

    weights: tuple[float, ...]
    start: float
    change: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, features: list[tuple[float, ...]]) -> list[int]:
        """The most probable sequence, 1 for boilerplate, by Viterbi decoding; content wins ties."""
        if not features:
            return []
        scores = (np.array(features) @ np.array(self.weights)).tolist()
        (cc, cb), (bc, bb) = self.change
        content, boiler, back = 0.0, self.start + scores[0], []
        for score in scores[1:]:
            from_boiler = (boiler + bc > content + cc, boiler + bb > content + cb)
            back.append(from_boiler)
            content, boiler = max(content + cc, boiler + bc), max(content + cb, boiler + bb) + score
        label = int(boiler > content)
        path = [label]
        for step in reversed(back):
            label = int(step[label])
            path.append(label)
        return path[::-1]


#: What is used where no labelled documents can be had.
DEFAULT = LineModel((-3.0, 4.0, 4.0, 2.0, 2.0, 5.0, 2.0, 0.5, 1.0, 0.5), 0.0, ((0.5, -0.5), (-0.5, 0.5)))


def fit_lines(examples: list[tuple[list[tuple[float, ...]], list[int]]], *, chain: bool = True, begin: LineModel | None = None, weights: list[float] | None = None, rounds: int = 60, rate: float = 0.5, ridge: float = 1e-3) -> LineModel:
    """Maximum likelihood of the labels by gradient ascent with Adagrad steps; forward-backward gives expectations.

    Sequences are padded to one length and go side by side; ``weights`` say how often each counts,
    once if not given. The ascent starts from ``begin``, or from zeros. Without ``chain`` the scores of
    changing between lines stay 0 and each line stands for itself.
    """
    often = np.array([w for (f, _), w in zip(examples, weights or [1.0] * len(examples), strict=True) if len(f)])
    examples = [(np.array(f), y) for f, y in examples if len(f)]
    if not examples:
        return DEFAULT
    size, sizes = len(FEATURES), np.array([len(y) for _, y in examples])
    features = np.zeros((len(examples), sizes.max(), size))
    labels = np.zeros(features.shape[:2], dtype=np.int64)
    for i, (f, y) in enumerate(examples):
        features[i, : len(y)], labels[i, : len(y)] = f, y
    inside = np.arange(features.shape[1]) < sizes[:, None]
    moves = inside[:, 1:]
    seen_moves = [float(often @ (moves & (labels[:, :-1] == i) & (labels[:, 1:] == j)).sum(axis=1)) for i, j in itertools.product((0, 1), repeat=2)]
    params, seen, total = np.zeros(size + 5), np.full(size + 5, 1e-6), float(often @ sizes)
    if begin:
        params[:] = [*begin.weights, begin.start, *begin.change[0], *begin.change[1]]
    for _ in range(rounds):
        line, start, change = params[:size], params[size], params[size + 1 :].reshape(2, 2)
        score = np.where(inside, features @ line, 0.0)
        forward, backward = np.zeros((*score.shape, 2)), np.zeros((*score.shape, 2))
        forward[:, 0, 1] = start + score[:, 0]
        for t in range(1, score.shape[1]):
            step = np.logaddexp(forward[:, t - 1, :1] + change[0], forward[:, t - 1, 1:] + change[1])
            step[:, 1] += score[:, t]
            forward[:, t] = np.where(inside[:, t, None], step, forward[:, t - 1])
        for t in range(score.shape[1] - 2, -1, -1):
            ahead = backward[:, t + 1] + np.stack((np.zeros(len(score)), score[:, t + 1]), axis=1)
            step = np.logaddexp(ahead[:, :1] + change[:, 0], ahead[:, 1:] + change[:, 1])
            backward[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        boiler = np.where(inside, np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]), 0.0)
        gradient = -ridge * params
        gradient[:size] += np.einsum("dtf,dt,d->f", features, labels - boiler, often) / total
        gradient[size] += often @ (labels[:, 0] - boiler[:, 0]) / total
        if chain:
            for k, (i, j) in enumerate(itertools.product((0, 1), repeat=2)):
                chance = forward[:, :-1, i] + change[i, j] + (score[:, 1:] if j else 0.0) + backward[:, 1:, j] - z[:, None]
                gradient[size + 1 + k] += (seen_moves[k] - often @ np.exp(np.where(moves, chance, -np.inf)).sum(axis=1)) / total
        else:
            gradient[size:] = 0.0
        seen += gradient**2
        params += rate * gradient / np.sqrt(seen)
    w = params.tolist()
    return LineModel(tuple(w[:size]), w[size], ((w[size + 1], w[size + 2]), (w[size + 3], w[size + 4])))


def refined_labels(model: LineModel, features: list[tuple[float, ...]], counts: list[int], quality: int, share: float = CONTENT_SHARE) -> list[int]:
    """Labels of the lines of a document of known quality: the model's, as far as the quality bears them out.

    ``counts`` are the words of each line. At least ``share`` of the words of a good document are
    content, and less than that of a bad one; where the model's labels say otherwise, the lines
    that are nearest to the other label by their own features change until it holds.
    """
    labels = model.labels(features)
    scores, total = (np.array(features) @ np.array(model.weights)).tolist(), sum(counts)
    content = total - sum(c for c, y in zip(counts, labels, strict=True) if y)
    order = sorted(range(len(labels)), key=lambda i: (scores[i], i), reverse=not quality)
    for i in order:
        if (content >= share * total) == bool(quality):
            break
        if labels[i] == quality:
            labels[i] = 1 - quality
            content += counts[i] if quality else -counts[i]
    return labels


def _lines(text: bytes) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and word counts of the lines that have words, and how many of them equal an earlier line."""
    seen, features, counts, repeats = set(), [], [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            duplicate = line in seen
            seen.add(line)
            repeats += duplicate
            features.append(line_features(line, words, duplicate))
            counts.append(len(words))
    return features, counts, repeats


def _sampled_lines(text: bytes, chance: int) -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and word counts of LINES consecutive lines, from a place that ``chance`` gives, or of all if there are fewer."""
    features, counts, _ = _lines(text)
    start = chance % max(1, len(counts) - LINES + 1)
    return features[start : start + LINES], counts[start : start + LINES]


def line_examples(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> list[tuple[list[tuple[float, ...]], list[int], int]]:
    """Features and word counts of the lines, and the quality, of up to ``sample`` documents each of quality 0 and 1.

    A document gives LINES lines at most, so no more than 2 * ``sample`` * LINES come to the
    driver; of rows with the same doc_id one counts. Rows of ``labels`` (doc_id, quality) with
    other qualities and documents without text or id are passed over.
    """
    chosen = first_by_hash(labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality"), "quality", sample)
    chosen = chosen.select(F.col("doc_id").cast("long").alias("__q_id"), F.col("quality").cast("long").alias("__q_quality")).dropDuplicates(["__q_id"])
    rows = docs.select(F.col("doc_id").cast("long").alias("__q_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "__q_id")

    def run(batches):
        for batch in batches:
            found = [_sampled_lines(t, i) for t, i in zip(as_bytes(batch.column("text")), batch.column("__q_id").to_pylist(), strict=True)]
            features = pa.array([[x for line in f for x in line] for f, _ in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("__q_id"), batch.column("__q_quality"), features, pa.array([c for _, c in found], pa.list_(pa.int64()))], ["id", "quality", "features", "counts"])

    found = rows.select("__q_id", "__q_quality", "text").mapInArrow(run, "id long, quality long, features array<double>, counts array<long>")
    found = found.groupBy("id", "quality").agg(F.min(F.struct("features", "counts")).alias("lines")).orderBy("id").collect()
    width = len(FEATURES)
    return [([tuple(r.lines.features[i : i + width]) for i in range(0, len(r.lines.features), width)], list(r.lines.counts), r.quality) for r in found if r.lines.counts]


def balance(labels: list[list[int]]) -> list[float]:
    """Weights of label sequences: those with both labels count together as much as all others."""
    both = [0 < sum(y) < len(y) for y in labels]
    share = max(1.0, (len(both) - sum(both)) / max(1, sum(both)))
    return [share if b else 1.0 for b in both]


def fit_documents(examples: list[tuple[list[tuple[float, ...]], list[int], int]]) -> LineModel:
    """Fit on lines of documents whose quality is known (features, word counts, quality) but not the label of each line.

    All lines of a bad document start as boilerplate, all of a good one as content. A first fit
    takes each line for itself, so that lines of a bad document that look like those of good ones
    score as content; ``refined_labels`` makes labels of that. The chain is fitted to these.
    Most documents have one label throughout, which says nothing of where labels change and would
    teach the chain never to change; so both kinds of document have the same weight.
    """
    lines = [f for f, _, _ in examples]
    single = fit_lines(list(zip(lines, [[1 - q] * len(c) for _, c, q in examples], strict=True)), chain=False, rounds=240)
    labels = [refined_labels(single, *example) for example in examples]
    return fit_lines(list(zip(lines, labels, strict=True)), begin=single, weights=balance(labels), rounds=120)


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> LineModel:
    """``fit_documents`` on ``line_examples``."""
    return fit_documents(line_examples(docs, labels, sample=sample))


def _repeated(packed: np.ndarray) -> int:
    """Words in three-word windows, given as one number each, that occur twice or more."""
    ordered = np.sort(packed)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    found = np.isin(packed, again)
    covered = np.zeros(len(packed) + 2, dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(packed)] |= found
    return int(covered.sum())


def _triples(ids: np.ndarray, size: int) -> np.ndarray:
    """One number for each three consecutive ids below ``size``, equal only for equal triples."""
    if size < 1 << 21:
        return (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    return pairs[:-1] * size + ids[2:]


def score_quality(docs: DataFrame, model: LineModel, *, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, content_share, n_lines, n_boilerplate.

    word_chars counts code points in words, n_symbols the characters #*$%&|<>, n_dup_lines the
    lines with a word that equal an earlier one, n_repeat_words the words in three-word windows
    found twice or more. base_failed: under 50 words, or over half of them in repeated windows.
    Viterbi decoding labels each line that has a word; the others take no part. kept is false if
    base_failed, else whether content_share, the share of words in content lines, reaches the
    bound. Null and empty texts have no words, content_share 0, and fail. Repeated rows each give
    a row; an empty table gives an empty result. Columns beside doc_id and text are not read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "n_lines", "n_boilerplate"]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2

    def run(batches):
        for batch in batches:
            vocabulary, used, rows = Vocabulary(), 0, []
            for text in as_bytes(batch.column("text")):
                text = text or b""
                used += len(text)
                if used > GROUP_BYTES:
                    vocabulary, used = Vocabulary(), len(text)
                words = text.split()
                n = len(words)
                ids = np.fromiter(map(vocabulary.__getitem__, words), dtype=np.int64, count=n)
                repeats = _repeated(_triples(ids, len(vocabulary))) if n > 3 else 0
                features, counts, copies = _lines(text)
                labels = model.labels(features)
                boiler = sum(c for c, y in zip(counts, labels, strict=True) if y)
                share = (n - boiler) / n if n else 0.0
                failed = n < 50 or 100 * repeats > 50 * n
                rows.append((n, _chars(text), _without(text, _SYMBOLS), copies, repeats, failed, not failed and share >= content_share, share, len(labels), sum(labels)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", *names])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _chars(text: bytes) -> int:
    """Code points of a text that are in words."""
    return len(text.translate(None, _SPACES + _CONTINUES))
