"""Places for what is kept between jobs: under the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Spark's switch: what a query shuffles is deleted when the query ends, not when the driver happens to collect its garbage.
_DELETE_SHUFFLED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of one bitmap of Spark's bitmap functions.
_BUCKET = 32768


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A local session that names none, as in tests, gets a temporary one; on a cluster it must be named."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = context.getCheckpointDir()
    return folder


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder for a table of this run."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(frame: DataFrame) -> DataFrame:
    """A checkpoint of ``frame`` in the checkpoint folder. What was shuffled to make it is deleted as soon as it is written."""
    conf = frame.sparkSession.conf
    checkpoint_folder(frame.sparkSession)
    before = conf.get(_DELETE_SHUFFLED, "false")
    conf.set(_DELETE_SHUFFLED, "true")
    try:
        return frame.select("*").checkpoint()  # a query takes the switch as it stands when it is made
    finally:
        conf.set(_DELETE_SHUFFLED, before)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``shared_folder`` that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bits_of(rows: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits as bytes, with those set that column ``bit`` names. Spark's bitmap aggregates join what tasks set; the bits come to the driver."""
    bitmaps = rows.groupBy(F.expr(f"bit div {_BUCKET}").alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit") % _BUCKET).alias("bitmap"))
    found = np.zeros(max(1, 1 << bits >> 3), dtype=np.uint8)
    for r in bitmaps.toLocalIterator():
        own = found[r.bucket * _BUCKET // 8 :][: _BUCKET // 8]
        own[:] = np.frombuffer(r.bitmap, dtype=np.uint8)[: len(own)]
    return found
