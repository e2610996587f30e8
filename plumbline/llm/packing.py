"""Packing token ids into rows of one length by best-fit decreasing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.tokens import END_OF_DOCUMENT, RANKS_PATH, byte_encoding

#: Ids in a row.
LENGTH = 2048
#: Ids that a task gathers before it packs them; the last lot of a task may be smaller.
LOT = 2_000_000
#: Rows in a matrix, at most.
MATRIX_ROWS = 256


class Capacities:
    """The open rows by the room they have left: a segment tree over 0..limit that counts them."""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.counts = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, change: int) -> None:
        node = self.size + room
        while node:
            self.counts[node] += change
            node >>= 1

    def put(self, row: int, room: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return a row with the least room that is at least ``need``, and that room."""
        counts, node = self.counts, self.size + need
        while not counts[node]:
            # up to the first subtree on the right that has rows
            while node & 1:
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            if node & (node - 1) == 0:
                return None
        while node < self.size:
            node *= 2
            if not counts[node]:
                node += 1
        room = node - self.size
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], limit: int) -> list[list[int]]:
    """Rows of indices of ``sizes``, each at most ``limit`` in sum: longest first, each into the fullest row that has room."""
    rows: list[list[int]] = []
    tree = Capacities(limit)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[i])
        row, room = found or (len(rows), limit)
        if not found:
            rows.append([])
        rows[row].append(i)
        tree.put(row, room - sizes[i])
    return rows


_ROW = [
    ("row_id", pa.int64(), "long"),
    ("ids", pa.list_(pa.int32()), "array<int>"),
    ("positions", pa.list_(pa.int32()), "array<int>"),
    ("cu_seqlens", pa.list_(pa.int32()), "array<int>"),
    ("doc_ids", pa.list_(pa.int64()), "array<long>"),
    ("pieces", pa.list_(pa.int32()), "array<int>"),
]


def _packed(pieces: list[tuple], limit: int, pad: int):
    """(ids, positions, cu_seqlens, doc_ids, piece numbers) of each row; pieces are (doc_id, number, ids)."""
    for row in best_fit_decreasing([len(ids) for _, _, ids in pieces], limit):
        sizes = [len(pieces[i][2]) for i in row]
        ends = np.cumsum(sizes)
        ids = np.full(limit, pad, dtype=np.int32)
        positions = np.zeros(limit, dtype=np.int32)
        for i, end, size in zip(row, ends.tolist(), sizes, strict=True):
            ids[end - size : end] = pieces[i][2]
            positions[end - size : end] = np.arange(size)
        yield ids, positions, [0, *ends.tolist()], [pieces[i][0] for i in row], [pieces[i][1] for i in row]


def _lots(batches, length: int, lot: int, path: str):
    """Pieces of whole documents, about ``lot`` ids at a time. Documents without ids give none."""
    encoding, pieces, held = byte_encoding(path), [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            ids = np.array(encoding.encode_ordinary(text), dtype=np.int32) if text else ()
            for number, start in enumerate(range(0, len(ids), length)):
                pieces.append((doc_id, number, ids[start : start + length]))
            held += len(ids)
            if held >= lot:
                yield pieces
                pieces, held = [], 0
    if pieces:
        yield pieces


def pack_documents(docs: DataFrame, *, length: int = LENGTH, pad: int = END_OF_DOCUMENT, lot: int = LOT, path: str = RANKS_PATH) -> DataFrame:
    """Rows of exactly ``length`` ids: row_id, ids, positions, cu_seqlens, doc_ids, pieces.

    A document longer than a row is cut into pieces of ``length`` ids and a rest, numbered from 0,
    so that its ids can be put together again. Each task packs its own documents, ``lot`` ids at a
    time, without a shuffle. cu_seqlens are the cumulative lengths of the segments of a row, from
    0; positions restart at 0 with each segment; what is left of a row is ``pad`` with position 0.

    row_id holds the task in its upper bits and depends on how the input is split, as does the
    packing; the ids of a document do not. Null and empty texts have no ids and are in no row.
    Repeated rows are packed each. An empty table gives an empty result. Columns beside doc_id and
    text are not read.
    """
    schema = pa.schema([(n, t) for n, t, _ in _ROW])

    def run(batches):
        base, count = TaskContext.get().partitionId() << 32, 0
        for pieces in _lots(batches, length, lot, path):
            rows = list(_packed(pieces, length, pad))
            for start in range(0, len(rows), MATRIX_ROWS):
                part = rows[start : start + MATRIX_ROWS]
                numbers = list(range(base + count, base + count + len(part)))
                count += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([numbers, *zip(*part, strict=True)], schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, _, t in _ROW))


def packed_matrices(docs: DataFrame, *, length: int = LENGTH, pad: int = END_OF_DOCUMENT, lot: int = LOT, path: str = RANKS_PATH) -> DataFrame:
    """The packed rows as binary matrices, for writing: matrix_id, n_rows, length, ids, positions,
    cu_seqlens (an array for each row), doc_ids and pieces (likewise).

    ids and positions are n_rows x length little-endian 32-bit integers, row by row. Rows are as
    in ``pack_documents``; matrix_id is the row_id of the first one.
    """
    names = ["matrix_id", "n_rows", "length", "ids", "positions", "cu_seqlens", "doc_ids", "pieces"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32()))]

    def run(batches):
        base, count = TaskContext.get().partitionId() << 32, 0
        for pieces in _lots(batches, length, lot, path):
            rows = list(_packed(pieces, length, pad))
            for start in range(0, len(rows), MATRIX_ROWS):
                ids, positions, ends, doc_ids, numbers = zip(*rows[start : start + MATRIX_ROWS], strict=True)
                values = [base + count, len(ids), length, np.stack(ids).astype("<i4").tobytes(), np.stack(positions).astype("<i4").tobytes(), list(ends), list(doc_ids), list(numbers)]
                count += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

    schema = "matrix_id long, n_rows int, length int, ids binary, positions binary, cu_seqlens array<array<int>>, doc_ids array<array<long>>, pieces array<array<int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def write_packed(docs: DataFrame, output: str, **options) -> None:
    """Write ``packed_matrices`` as Parquet with binary columns, to any file system that Spark writes to."""
    packed_matrices(docs, **options).write.mode("overwrite").parquet(output)


def packing_digest(docs: DataFrame, **options) -> DataFrame:
    """One row per packed row: row_id, n_ids, doc_ids, pieces, cu_seqlens, ids_sha256, positions_sha256.

    The digests are of the row's ids and positions as little-endian 32-bit integers, read back from the matrices.
    """
    names = ["row_id", "n_ids", "doc_ids", "pieces", "cu_seqlens", "ids_sha256", "positions_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            for m in batch.to_pylist():
                step = 4 * m["length"]
                digests = [[hashlib.sha256(m[c][i * step : (i + 1) * step]).hexdigest() for i in range(m["n_rows"])] for c in ("ids", "positions")]
                columns = [[m["matrix_id"] + i for i in range(m["n_rows"])], [e[-1] for e in m["cu_seqlens"]], m["doc_ids"], m["pieces"], m["cu_seqlens"], *digests]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    schema = "row_id long, n_ids long, doc_ids array<long>, pieces array<int>, cu_seqlens array<int>, ids_sha256 string, positions_sha256 string"
    return packed_matrices(docs, **options).mapInArrow(run, schema)
