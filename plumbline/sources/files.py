"""Files by Hadoop's file systems, so that paths may lie on any store that Spark reads, and a place for files between jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _place(path: str, spark: SparkSession | None = None):
    spark = spark or SparkSession.active()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def is_there(path: str) -> bool:
    """Whether there is a file, or a folder of part files, at a path."""
    store, where = _place(path)
    return store.exists(where)


def matching(folder: str, pattern: str) -> list[str]:
    """The files of a folder that match a pattern, by name."""
    store, where = _place(f"{folder.rstrip('/')}/{pattern}")
    return sorted(f.getPath().toString() for f in store.globStatus(where) or [])


def part_files(path: str) -> list[str]:
    """The file itself, or the part files of a folder that have any bytes, in order of their names; as locations that Spark reads."""
    store, where = _place(path)
    status = store.getFileStatus(where)
    files = [status] if status.isFile() else sorted((f for f in store.listStatus(where) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().getName())
    return [f.getPath().toUri().toString() for f in files]


def first_bytes(path: str, count: int) -> bytes:
    """The first bytes of a file, or of the first part file with any in a folder; nothing else is read."""
    for location in part_files(path)[:1]:
        store, where = _place(location)
        stream = store.open(where)
        try:
            read = SparkSession.active().sparkContext._jvm.org.apache.commons.io
            return bytes(read.IOUtils.toByteArray(read.input.BoundedInputStream(stream, count)))
        finally:
            stream.close()
    return b""


def first_line(path: str, *, most: int = 1 << 24) -> bytes:
    """The first line of a file, without its end; of the file not much more than that is read, and ``most`` bytes at most."""
    store, where = _place(path)
    read = SparkSession.active().sparkContext._jvm.org.apache.commons.io
    stream, found = store.open(where), b""
    try:
        while not (b"\n" in found or b"\r" in found) and len(found) < most:
            more = bytes(read.IOUtils.toByteArray(read.input.BoundedInputStream(stream, max(8192, len(found)))))
            if not more:
                break
            found += more
    finally:
        stream.close()
    return found.splitlines()[0] if found else b""


def shared_root(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all machines share. A local session without one, as in tests, gets a temporary folder; on a cluster it must be named."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def cut_lineage(frame: DataFrame) -> DataFrame:
    """A checkpoint of ``frame`` under the shared folder."""
    shared_root(frame.sparkSession)
    return frame.checkpoint()


def workspace(spark: SparkSession, name: str) -> str:
    """A new path for a table under the shared folder, removed when the session's JVM ends, or before by ``remove``."""
    folder = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    store, where = _place(folder, spark)
    store.mkdirs(where)
    store.deleteOnExit(where)
    return f"{folder}/rows"


def remove(path: str) -> None:
    """Delete a file or folder, if it is there."""
    store, where = _place(path)
    store.delete(where, True)


def publish(staged: str, final: str) -> None:
    """Put a staged file or folder in its place by renaming it; what was there goes first."""
    store, where = _place(final)
    store.delete(where, True)
    if not store.rename(_place(staged)[1], where):
        raise OSError(f"{staged} could not be renamed to {final}")


def expanded(paths: list[str]) -> list[str]:
    """Files as they are, and the CSV files of each folder, in order of their names and each once."""
    found = []
    for path in paths:
        store, where = _place(path)
        if not store.exists(where):
            raise FileNotFoundError(path)
        found += [path] if store.getFileStatus(where).isFile() else matching(path, "*.csv")
    return list(dict.fromkeys(found))


def read_text(path: str) -> str:
    """A small file as text."""
    store, where = _place(path)
    stream = store.open(where)
    try:
        return bytes(SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Write a small file, in place of one that is there."""
    store, where = _place(path)
    stream = store.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
