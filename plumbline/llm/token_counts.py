"""Tokens per document in flat files of token ids without an index, by a scan for separators."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.storage import cut_lineage, remove_folder, shared_folder
from plumbline.llm.tokens import END_OF_DOCUMENT, RANKS_PATH, byte_encoding

#: Bytes of a block, a multiple of any id's size.
BLOCK_BYTES = 1 << 18
#: Bytes of a file that a task reads in one go, about, and tasks at most; with more spans than these a task reads several.
SPAN_BYTES, MOST_TASKS = 64 << 20, 100_000


def _store(location: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a location and the path in it. Spark writes file:/x where pyarrow wants file:///x."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", location))


def read_spans(files: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of the flat files of (path, length): file, block (from 0), payload.

    Each task reads spans of SPAN_BYTES by offset, so one large file spreads over many tasks.
    """

    def ranges(batches):
        for batch in batches:
            for file, first, length in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "length")), strict=True):
                store, place = _store(file)
                with store.open_input_file(place) as stream:
                    for block in range(first, min(first + per_span, -(-length // block_bytes))):
                        payload = stream.read_at(min(block_bytes, length - block * block_bytes), block * block_bytes)
                        yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], ["file", "block", "payload"])

    per_span = max(1, SPAN_BYTES // block_bytes)
    files = files.where("length > 0").select("path", "length")
    spans = files.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {per_span * block_bytes}"))).alias("span"))
    count = files.agg(F.sum(F.expr(f"(length - 1) div {per_span * block_bytes} + 1"))).first()[0] or 1
    return spans.select("path", "length", (F.col("span") * per_span).alias("first")).repartition(min(count, MOST_TASKS), "path", "first").mapInArrow(ranges, "file string, block long, payload binary")


def read_flat_files(spark: SparkSession, path: str, *, block_bytes: int = BLOCK_BYTES, whole: bool = False) -> DataFrame:
    """Blocks of flat files of any size: file, block (from 0), payload.

    Files are listed with their lengths only, then read as in ``read_spans``, by pyarrow's file
    systems; for a store that these do not know, ``whole`` lets Spark read each file by one task,
    up to 2 GB.
    """
    listed = spark.read.format("binaryFile").load(path)

    def cut(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for i, start in enumerate(range(0, len(content), block_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([i], pa.int64()), pa.array([content[start : start + block_bytes]], pa.binary())], ["file", "block", "payload"])

    if whole:
        return listed.select("path", "content").mapInArrow(cut, "file string, block long, payload binary")
    return read_spans(listed, block_bytes=block_bytes)


def write_flat_files(docs: DataFrame, folder: str, *, block_bytes: int = BLOCK_BYTES, path: str = RANKS_PATH, end: int = END_OF_DOCUMENT) -> DataFrame:
    """The streams of ``flat_token_blocks`` as flat files of 16-bit ids in ``folder``, one for each task.

    Gives file, block, length (of the payload) and doc_ids: the list beside the files. A task that
    runs again writes another file; the list, once it is stored, names those that count. The
    folder is on a store that pyarrow knows.
    """

    def run(batches):
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        stream = name = None
        for batch in batches:
            if stream is None and batch.num_rows:
                name = f"{batch.column('file')[0].as_py()}-{uuid.uuid4().hex}.ids"
                stream = store.open_output_stream(f"{place}/{name}")
            sizes = []
            for payload in batch.column("payload"):
                stream.write(payload.as_buffer())
                sizes.append(len(payload.as_buffer()))
            if sizes:
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(sizes)), batch.column("block"), pa.array(sizes, pa.int64()), batch.column("doc_ids")], ["file", "block", "length", "doc_ids"])
        if stream is not None:
            stream.close()

    return flat_token_blocks(docs, block_bytes=block_bytes, path=path, end=end).mapInArrow(run, "file string, block long, length long, doc_ids array<long>")


def count_by_files(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, path: str = RANKS_PATH, end: int = END_OF_DOCUMENT) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat files that are written, read by ranges and removed.

    The files lie in the shared folder meanwhile, two bytes for each token and document. Only small
    rows of each block are shuffled: counts between separators, and the doc_ids beside the files.
    Otherwise as ``flat_token_blocks`` and ``count_tokens``.
    """
    spark, folder = docs.sparkSession, shared_folder(docs.sparkSession, "token-files")
    write_flat_files(docs, f"{folder}/ids", block_bytes=block_bytes, path=path, end=end).write.parquet(f"{folder}/list")
    listed = spark.read.parquet(f"{folder}/list")
    files = listed.groupBy(F.col("file").alias("path")).agg(F.sum("length").alias("length"))
    counts = count_tokens(read_spans(files, block_bytes=block_bytes), end=end, names=listed.select("file", "block", "doc_ids"))
    counts = cut_lineage(counts.select("doc_id", "n_tokens"))
    remove_folder(spark, folder)
    return counts


def flat_token_blocks(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES, path: str = RANKS_PATH, end: int = END_OF_DOCUMENT) -> DataFrame:
    """The documents as flat streams of 16-bit ids, one per task, each document followed by ``end``, in blocks.

    Gives file, block, payload and doc_ids, those of the documents whose separator is in the
    block: the list that a corpus writer keeps beside its flat files. Null and empty texts are
    documents without ids, repeated rows are documents each, an empty table gives no blocks, and
    columns beside doc_id and text are not read.
    """
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches):
        encoding, file = byte_encoding(path), f"part-{TaskContext.get().partitionId():05d}"
        held, ended, size, number = [], [], 0, 0
        separator = np.array([end], dtype="<u2").tobytes()

        def block(payload, ids):
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((file, number, payload, ids), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = np.array(encoding.encode_ordinary(text or ""), dtype="<u2").tobytes() + separator
                held.append(data)
                size += len(data)
                ended.append((size, doc_id))  # where the separator ends, in bytes from the start of the next block
                while size >= block_bytes:
                    data = b"".join(held)
                    yield block(data[:block_bytes], [d for at, d in ended if at <= block_bytes])
                    ended = [(at - block_bytes, d) for at, d in ended if at > block_bytes]
                    held, size, number = [data[block_bytes:]], size - block_bytes, number + 1
        if size:
            yield block(b"".join(held), [d for _, d in ended])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, block long, payload binary, doc_ids array<long>")


def scan_separators(blocks: DataFrame, *, end: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """file, block, counts and tail of each block, with doc_ids where ``blocks`` has them.

    counts are the ids before each separator since the one before it, or since the start of the
    block; tail are those after the last one, or all. Payloads hold whole ids and may be null or empty.
    """
    named = "doc_ids" in blocks.columns
    columns = ["file", "block", "payload"] + ["doc_ids"] * named

    def run(batches):
        for batch in batches:
            counts, tails = [], []
            for payload in batch.column("payload").to_pylist():
                ids = np.frombuffer(payload or b"", dtype=dtype)
                at = np.flatnonzero(ids == end)
                counts.append(np.diff(at, prepend=-1) - 1)
                tails.append(len(ids) - 1 - (int(at[-1]) if len(at) else -1))
            arrays = [batch.column("file"), batch.column("block"), pa.array(counts, pa.list_(pa.int64())), pa.array(tails, pa.int64())]
            names = ["file", "block", "counts", "tail"]
            if named:
                arrays, names = [*arrays, batch.column("doc_ids")], [*names, "doc_ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "file string, block long, counts array<long>, tail long" + ", doc_ids array<long>" * named
    return blocks.select(F.col("file").cast("string"), F.col("block").cast("long"), *columns[2:]).mapInArrow(run, schema)


def count_tokens(blocks: DataFrame, *, end: int = END_OF_DOCUMENT, dtype: str = "<u2", names: DataFrame | None = None) -> DataFrame:
    """One row per document of the files: file, ordinal (from 0 in its file), n_tokens, and doc_id where ``blocks``, or ``names`` by file and block, has doc_ids.

    Blocks (file, block, payload) may come in any order. Boundaries are stitched by a prefix scan
    over the blocks of each file: a document that began in earlier blocks gets their tails since
    the last separator. Only one small row per block is shuffled for that.

    Separators are not counted. Two separators in a row, or one at the start, give a document with
    0 tokens; ids after a file's last separator are a last document (doc_id null); a file without
    ids has none. No blocks give an empty result.
    """
    parts = scan_separators(blocks, end=end, dtype=dtype)
    if names is not None:
        parts = parts.join(names, ["file", "block"])
    named = "doc_ids" in parts.columns
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.size("counts").cast("long")
    # tails before a block, and what they had come to at the last block with a separator
    sums = parts.withColumns({"sum_before": F.coalesce(F.sum("tail").over(before), F.lit(0)), "first": F.coalesce(F.sum(ends).over(before), F.lit(0)), "next": F.lead("block").over(order)})
    carry = F.col("sum_before") - F.coalesce(F.max(F.when(ends > 0, F.col("sum_before"))).over(before), F.lit(0))
    sums = sums.withColumn("carry", carry)
    head = F.when(ends > 0, F.array(F.col("carry") + F.element_at("counts", 1))).otherwise(F.array().cast("array<long>"))
    rest = F.when(ends > 1, F.slice("counts", F.lit(2), F.size("counts") - 1)).otherwise(F.array().cast("array<long>"))
    open_end = F.when(ends > 0, F.lit(0)).otherwise(F.col("carry")) + F.col("tail")
    last = F.when(F.col("next").isNull() & (open_end > 0), F.array(open_end)).otherwise(F.array().cast("array<long>"))
    found = sums.select("file", "first", *(["doc_ids"] if named else []), F.posexplode(F.concat(head, rest, last)).alias("place", "n_tokens"))
    doc = [F.get("doc_ids", F.col("place")).alias("doc_id")] if named else []
    return found.select(*doc, "file", (F.col("first") + F.col("place")).alias("ordinal"), "n_tokens")
