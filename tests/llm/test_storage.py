"""Places for what is kept between jobs."""

import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import storage


def session(master, folder=None):
    made = []
    context = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": folder}, getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=context)


def test_folder_is_named_on_clusters():
    assert storage.checkpoint_folder(session("spark://a:7077", "s3a://b/c")) == "s3a://b/c"
    assert storage.checkpoint_folder(session("local[4]")) and storage.checkpoint_folder(session("local"))
    for master in ("spark://a:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            storage.checkpoint_folder(session(master))


def test_checkpoint_deletes_what_it_shuffled(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for f in manager.getAllFiles().mkString("\n").split("\n") if (name := f.rsplit("/", 1)[-1]).startswith("shuffle_")}
    before = shuffled()
    counts = spark.range(20_000).groupBy((F.col("id") % 1000).alias("k")).count()
    found = storage.cut_lineage(counts.repartition(3, "count"))
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert found.agg(F.sum("count")).first()[0] == 20_000 and counts.count() == 1000
    assert spark.conf.get(storage._DELETE_SHUFFLED) == "false"


@pytest.mark.parametrize("bits", [3, 10, 17])
def test_bits(spark, bits):
    places = sorted({i * 7919 % (1 << bits) for i in range(50)})
    found = storage.bits_of(spark.createDataFrame([(p,) for p in [*places, places[0]]], "bit long"), bits)
    assert np.flatnonzero(np.unpackbits(found, bitorder="little")).tolist() == places
    assert not storage.bits_of(spark.createDataFrame([], "bit long"), bits).any()
