"""Near-duplicate detection by order MinHash with verification by banded alignment."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.columns import HOT_SHARE, join_weighted
from plumbline.llm.components import connected_components
from plumbline.llm.storage import cut_lineage
from plumbline.llm.words import WordHashes, as_bytes, lots, mixed, rolling

#: Words of a k-mer.
SHINGLE = 5
#: Similarity from which two documents are linked.
SIMILARITY = 0.8
#: Sketches of a document, and the k-mers of each: two documents of similarity s agree in one with probability s**KMERS.
SKETCHES, KMERS = 16, 4
#: Members up to which a bucket compares all of them; those of larger ones meet its pivots and then texts of other classes by a prefix-filter join.
BUCKET = 32
#: Members of a larger bucket that all its members meet.
PIVOTS = 4
#: Bits of a shingle's hash that name its bin in the counts that order shingles, at most (16 MB).
BIN_BITS = 22
#: Crowded texts of a lot, about; the pairs of two lots are verified together.
LOT = 128
#: Bytes of text that are sketched together, about; a longer text goes alone.
LOT_BYTES = 1 << 20
#: Different words whose hashes are remembered.
REMEMBERED = 1 << 19

_STEPS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64)) | np.uint64(1)
_POWERS = mixed(np.arange(101, 101 + KMERS, dtype=np.uint64)) | np.uint64(1)


def labelled_shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of a text in order, plain and joined with their occurrence number.

    A text with fewer words has one shingle, all of it; one without words has none.
    """
    if not len(hashes):
        return hashes, hashes
    shingles = rolling(hashes, min(SHINGLE, len(hashes)))
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    starts = np.flatnonzero(new)
    number = np.empty(len(shingles), dtype=np.uint64)
    number[order] = np.arange(len(shingles)) - np.repeat(starts, np.diff(np.append(starts, len(shingles))))
    return shingles, mixed(shingles + number * np.uint64(0x9E3779B97F4A7C15))


def sketch(labelled: np.ndarray) -> list[int]:
    """Order MinHash: for each hash order the smallest labelled k-mers, kept in text order, as one 64-bit key."""
    n = len(labelled)
    if not n:
        return []
    keys = np.empty(SKETCHES, dtype=np.uint64)
    take = min(KMERS, n)
    # a very long text goes one hash order at a time
    lots = [slice(0, SKETCHES)] if n <= 100_000 else [slice(i, i + 1) for i in range(SKETCHES)]
    for lot in lots:
        ranked = labelled[None, :] * _STEPS[lot, None]
        ranked ^= ranked >> np.uint64(32)
        places = np.argpartition(ranked, take - 1, axis=1)[:, :take] if take < n else np.broadcast_to(np.arange(n), (ranked.shape[0], n))
        chosen = labelled[np.sort(places, axis=1)]
        keys[lot] = (chosen * _POWERS[:take]).sum(axis=1, dtype=np.uint64)
    return mixed(keys + _STEPS).view(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Length of the longest common subsequence of two sequences whose matches lie at most ``band`` off the diagonal.

    Bit-parallel: one integer holds a row of the alignment, masked to the band.
    """
    n, m = len(a), len(b)
    short = min(n, m)
    same = np.flatnonzero(a[:short] != b[:short])
    head = int(same[0]) if len(same) else short
    same = np.flatnonzero(a[head:][::-1][: short - head] != b[head:][::-1][: short - head])
    tail = int(same[0]) if len(same) else short - head
    left, right = a[head : n - tail].tolist(), b[head : m - tail].tolist()
    if not left or not right:
        return head + tail
    places: dict[int, int] = {}
    for i, x in enumerate(left):
        places[x] = places.get(x, 0) | 1 << i
    full, window = (1 << len(left)) - 1, (1 << (2 * band + 1)) - 1
    row = full
    for j, y in enumerate(right):
        match = places.get(y, 0)
        if match:
            match &= window << (j - band) if j >= band else window >> (band - j)
            step = row & match
            row = ((row + step) | (row - step)) & full
    return head + tail + len(left) - row.bit_count()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of both texts, or 0 if that is below ``least``.

    Counting common labelled shingles bounds it from above and spares most alignments. Matches of
    an alignment that reaches ``least`` lie within the band, so the band loses none.
    """
    n, m = len(a[0]), len(b[0])
    common = len(np.intersect1d(a[1], b[1], assume_unique=True))
    if not common or common < least * (n + m - common):
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least)) + 1
    found = aligned(a[0], b[0], band)
    score = found / (n + m - found)
    return score if score >= least else 0.0


def _blocks(texts: list[bytes | None]):
    """The labelled shingles of each text."""
    words = WordHashes()
    for text in texts:
        if len(words) > REMEMBERED:
            words.clear()
        yield labelled_shingles(words.of(text))


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (MD5 of the text; null counts as empty) and keys, the order MinHash keys."""

    def run(batches):
        for lot in lots(batches, LOT_BYTES):
            texts = [t or b"" for t in as_bytes(lot.column("text"))]
            keys = [sketch(labelled) for _, labelled in _blocks(texts)]
            arrays = [lot.column("doc_id"), pa.array([hashlib.md5(t).hexdigest() for t in texts], pa.string()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text_key string, keys array<long>")


def _buckets(texts: DataFrame) -> DataFrame:
    """The keys that several of ``texts`` (rep, keys) share: key, n_members and pivots, the members that come first by each of PIVOTS hashes.

    All of it is summed up before it is shuffled.
    """
    members = texts.select("rep", F.explode("keys").alias("key"))
    firsts = [F.min(F.struct(F.xxhash64(F.lit(i), "rep").alias("h"), "rep")).alias(f"p{i}") for i in range(PIVOTS)]
    found = members.groupBy("key").agg(F.count(F.lit(1)).alias("n_members"), *firsts).where("n_members > 1")
    return found.select("key", "n_members", F.array_distinct(F.array(*(F.col(f"p{i}.rep") for i in range(PIVOTS)))).alias("pivots"))


def candidate_pairs(texts: DataFrame, buckets: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ``texts`` (rep, keys) that share a bucket of at most BUCKET members: all of them."""
    small = buckets.where(F.col("n_members") <= BUCKET).select("key")
    members = texts.select("rep", F.explode("keys").alias("key")).join(small, "key")
    left, right = members.select("key", F.col("rep").alias("a")), members.select("key", F.col("rep").alias("b"))
    return left.join(right, "key").where("a < b").select("a", "b").distinct()


def crowded_members(texts: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """rep and pivots for each of ``texts`` (rep, keys; ``total`` rows) and each bucket of more than BUCKET members that it falls into.

    Buckets with at least HOT_SHARE of all members, 1 / HOT_SHARE of them at most, are broadcast, so that no key of the shuffle join is hot.
    """
    large = buckets.where(F.col("n_members") > BUCKET).select("key", "n_members", "pivots")
    bound = F.lit(total * SKETCHES * HOT_SHARE)
    hot, rest = large.where(F.col("n_members") >= bound).drop("n_members"), large.where(F.col("n_members") < bound).drop("n_members")
    members = texts.select("rep", F.explode("keys").alias("key"))
    of_hot = members.join(F.broadcast(hot), "key")
    of_rest = members.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key")
    return of_hot.select("rep", "pivots").union(of_rest.select("rep", "pivots"))


def pivot_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of each of ``members`` (rep, pivots) with its pivots."""
    both = members.select("rep", F.explode("pivots").alias("pivot")).where("rep <> pivot")
    return both.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def prefix_lengths(n: int, least: float) -> tuple[int, int]:
    """How many of the n shingles of a text, in any order that all texts share, must be met by a longer and by a shorter one.

    Two texts of n <= m shingles at a similarity of ``least`` have at least ``least / (1 + least)
    * (n + m)`` in common, so n by itself asks for ``2 * least / (1 + least) * n`` of the shorter
    text and ``least * m`` of the longer one. The first common one then lies in both prefixes.
    """
    return n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1, n - math.ceil(least * n - 1e-9) + 1


def crowded_pairs(docs: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b), a < b, of ``docs`` (id, text, root) of different roots that can have a similarity of ``least``, by a prefix-filter join.

    The shared order of shingles puts rare ones first, by counts of bins of their
    hashes, about as many as there are shingles and 2**BIN_BITS at most, so what a template gives to many texts is at the end. Any order is exact; this one
    keeps template shingles out of the prefix of a shorter text unless it hardly differs from them.

    Texts of one root are in one class already and need not meet again. A shingle whose texts all
    have one root goes: most are not even spelled out, as the bins tell whether several roots meet
    in them. Of any other, the texts of its most frequent root meet only the texts of other roots.
    So a family that its pivots have put together makes rows where it shares shingles with others.
    """

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(BIN_BITS, max(10, math.ceil(math.log2(max(1, size / 4)))))
    shift = np.uint64(64 - bits)

    def count(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                bins = [labelled >> shift for _, labelled in _blocks(as_bytes(part.column("text")))]
                roots = np.repeat(part.column("root").to_numpy(), [len(x) for x in bins])
                bins = np.concatenate(bins)
                order = np.argsort(bins)
                used, starts, counts = np.unique(bins[order], return_index=True, return_counts=True)
                ends = [f.reduceat(roots[order], starts) if len(used) else roots for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(counts), *map(pa.array, ends)], ["bin", "n", "low", "high"])

    counted = docs.select("root", "text").mapInArrow(count, "bin long, n long, low long, high long").groupBy("bin")
    counted = counted.agg(F.sum("n").alias("n"), (F.min("low") < F.max("high")).alias("shared")).toArrow()
    places = counted.column("bin").to_numpy()
    bins, meeting = np.zeros(1 << bits, dtype=np.float32), np.zeros(1 << bits, dtype=bool)
    bins[places] = counted.column("n").to_numpy()
    meeting[places] = counted.column("shared").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast((bins, meeting))

    def prefixes(batches):
        frequency, meeting = shared.value
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, max(1, batch.num_rows), 256)):
                columns = [[], [], [], [], [], []]
                for rep, root, (_, labelled) in zip(part.column("id").to_pylist(), part.column("root").to_pylist(), _blocks(as_bytes(part.column("text"))), strict=True):
                    if n := len(labelled):
                        short, long = prefix_lengths(n, least)
                        ordered = labelled[np.lexsort((labelled, frequency[(labelled >> shift).astype(np.int64)]))]
                        places = np.flatnonzero(meeting[(ordered[:long] >> shift).astype(np.int64)])
                        kept = len(places)
                        for column, values in zip(columns, (np.full(kept, rep), np.full(kept, root), ordered[places].view(np.int64), np.full(kept, n), places, places < short), strict=True):
                            column.append(values)
                kinds = (np.int64, np.int64, np.int64, np.int64, np.int64, bool)
                arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, dtype=k)) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["rep", "root", "shingle", "n", "place", "short"])

    found = cut_lineage(docs.select("id", "root", "text").mapInArrow(prefixes, "rep long, root long, shingle long, n long, place long, short boolean"))
    roots = found.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("texts"))
    mixed_ones = roots.groupBy("shingle").agg(F.max(F.struct("texts", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    found = cut_lineage(found.join(mixed_ones.select("shingle", F.col("most.root").alias("main")), "shingle"))
    named = lambda side, rows: rows.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in ("rep", "root", "n", "place")))
    apart = F.col("x_root") != F.col("y_root")
    shorter = (F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_rep") < F.col("y_rep")))
    # if this is their first common shingle, no more than what follows in both can be common beside it
    most = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
    near = apart & shorter & (most >= F.lit(least / (1 + least)) * (F.col("x_n") + F.col("y_n")) - F.lit(1e-6))
    lesser, main = found.where("root <> main"), found.where("root = main")
    meet = lambda x, y: named("x", x.where("short")).join(named("y", y), "shingle").where(near)
    both = meet(lesser, found).union(meet(main, lesser))
    return both.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def verify_crowded(pairs: DataFrame, docs: DataFrame, count: int, *, least: float = SIMILARITY) -> DataFrame:
    """As ``verify_pairs`` for many pairs of few of ``docs`` (id, text; ``count`` rows): texts are sent once per pair of lots, not once per pair."""
    lots = F.lit(-(-count // LOT) or 1)
    lot = lambda c: F.pmod(F.xxhash64(F.col(c)), lots)
    pairs = pairs.select("a", "b", lot("a").alias("lot_a"), lot("b").alias("lot_b"))
    ends = pairs.select("lot_a", "lot_b", F.explode(F.array("a", "b")).alias("id")).distinct()
    sent = ends.join(docs, "id").select("lot_a", "lot_b", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    rows = sent.union(pairs.select("lot_a", "lot_b", "a", "b", F.lit(None).cast("string")))
    rows = rows.repartition("lot_a", "lot_b").sortWithinPartitions("lot_a", "lot_b", F.col("b").asc_nulls_first())

    def run(batches):
        shingles, words, of = {}, WordHashes(), None
        for batch in batches:
            out = []
            lots = zip(batch.column("lot_a").to_pylist(), batch.column("lot_b").to_pylist(), strict=True)
            for here, a, b, text in zip(lots, batch.column("a").to_pylist(), batch.column("b").to_pylist(), as_bytes(batch.column("text")), strict=True):
                if here != of:
                    shingles, of = {}, here
                if b is None:
                    if len(words) > REMEMBERED:
                        words.clear()
                    shingles.setdefault(a, []).append(labelled_shingles(words.of(text)))
                elif score := max(similarity(x, y, least) for x in shingles[a] for y in shingles[b]):
                    out.append((a, b, score))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    return rows.mapInArrow(run, "a long, b long, similarity double")


def verify_pairs(pairs: DataFrame, docs: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """The pairs whose texts align to a similarity of at least ``least``: a, b, similarity. Texts meet by joins on their ids."""
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    both = pairs.join(texts, F.col("a") == F.col("id")).select("a", "b", F.col("text").alias("text_a"))
    both = both.join(texts, F.col("b") == F.col("id")).select("a", "b", "text_a", F.col("text").alias("text_b"))

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, max(1, batch.num_rows), 256)):
                lefts, rights = (list(_blocks(as_bytes(part.column(c)))) for c in ("text_a", "text_b"))
                scores = pa.array([similarity(x, y, least) for x, y in zip(lefts, rights, strict=True)], pa.float64())
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), scores], ["a", "b", "similarity"])
                yield out.filter(pa.array([s > 0 for s in scores.to_pylist()], pa.bool_()))

    return both.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, link_to, similarity.

    copy_of is the smallest doc_id with the same text, class_id the smallest of the connected
    component of links. link_to is the copy_of of another text of the class to which this text has
    a verified link, that of the greatest ``similarity`` among the links that were looked at, the
    smallest of equal ones; both are null for texts without a link. Two texts are linked if their aligned five-word shingles are at least
    ``least`` of all shingles of both. Order MinHash keys make candidates: at a similarity of 0.8
    a pair shares none with a probability of 0.0002. All members of a bucket of up to BUCKET meet.
    Those of a larger one meet its pivots, which puts most of a family into one class; then texts
    of large buckets that are still in different classes meet by an exact prefix-filter join, so
    no link between classes is passed over, and links inside a class need not be counted.

    Null counts as an empty text; texts without words are only linked as copies. Rows that repeat
    a doc_id share its class. Rows with a null doc_id get the class of their text, null if no
    other row has it. An empty table gives an empty result. Columns beside doc_id and text are not
    read.
    """
    sketches = sketch_documents(docs)
    texts = sketches.groupBy("text_key").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n_copies"), F.first("keys").alias("keys"))
    texts = cut_lineage(texts)
    reps = texts.where("copy_of IS NOT NULL").select(F.col("copy_of").alias("rep"), "keys")
    buckets = cut_lineage(_buckets(reps))
    found = verify_pairs(candidate_pairs(reps, buckets), docs, least=least)
    members = cut_lineage(crowded_members(reps, buckets, reps.count()))
    crowded = members.select(F.col("rep").alias("id")).distinct()
    count = crowded.count()
    if count:
        of = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(crowded, "id").dropDuplicates(["id", "text"])
        of = cut_lineage(of)
        found = found.union(verify_crowded(pivot_pairs(members), of, count, least=least))
    links = cut_lineage(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")))
    roots = cut_lineage(connected_components(links.select("a", "b")))
    if count:
        placed = of.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("id", "text", F.coalesce("root", "id").alias("root"))
        more = cut_lineage(verify_crowded(crowded_pairs(placed, least=least), of, count, least=least))
        if not more.isEmpty():
            roots = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more.select("a", "b")))
            links = links.union(more)
    ends = links.select(F.inline(F.array(*[F.struct(F.col(x).alias("link"), F.struct("similarity", (-F.col(y)).alias("less")).alias("to")) for x, y in (("a", "b"), ("b", "a"))])))
    nearest = ends.groupBy("link").agg(F.max("to").alias("to")).select("link", (-F.col("to.less")).alias("link_to"), F.col("to.similarity").alias("similarity"))
    linked = roots.where("node <> root")
    heads = linked.select(F.col("root").alias("node"), "root").distinct()
    classes = texts.drop("keys").join(linked.union(heads), F.col("copy_of") == F.col("node"), "left").where("n_copies > 1 OR root IS NOT NULL")
    classes = classes.join(nearest, F.col("copy_of") == F.col("link"), "left").select("text_key", "copy_of", "n_copies", F.coalesce("root", "copy_of").alias("class_id"), "link_to", "similarity")
    rows = docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    found = join_weighted(rows, classes, ["text_key"], "n_copies", docs.count())
    single = F.col("n_copies").isNull()
    return found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(single, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        "link_to",
        "similarity",
    )


def drop_near_duplicates(docs: DataFrame, *, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its class, with all their columns; rows with a null doc_id stay."""
    gone = near_duplicates(docs, least=least).where("doc_id <> class_id").select(F.col("doc_id").alias("__near_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__near_id"), "left_anti")
