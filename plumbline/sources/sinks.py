"""Where results go: tables, single JSON or CSV files, predictions and status rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class EmptyResultError(ValueError):
    """A table that must have rows has none."""


def write_table(rows: DataFrame, path: str, *, by=(), mode: str = "overwrite") -> None:
    rows.write.mode(mode).partitionBy(*by).parquet(path)


def write_predictions(scores: DataFrame, path: str) -> None:
    """Single-precision scores and labels by experiment, seed and split."""
    rows = scores.select("experiment_id", "seed", "split", "client", F.col("p").cast("float").alias("probability"), F.col("label").cast("tinyint").alias("label"))
    write_table(rows, path, by=("experiment_id", "seed", "split"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One CSV file with a header, for tables with a row per round, run or trial."""
    if not rows.limit(1).collect():
        raise EmptyResultError(f"nothing to write to {path}")
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv_parts(rows: DataFrame, path: str) -> None:
    """CSV part files, each with the header, written by as many tasks as ``rows`` has partitions; sorted rows stay in the order of the files' names."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def with_first_line(header: str):
    """For ``mapInArrow`` on rows of one text column: every task's rows with ``header`` before them."""

    def run(batches):
        first = True
        for batch in batches:
            if first and batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.types[0])], batch.schema.names)
                first = False
            yield batch

    return run


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON-lines file of nested records, for tables with a row per client or group."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_status(rows: DataFrame, path: str) -> None:
    """Append status rows (experiment_id, seed, status, detail, at); the latest of each run counts, see ``read_status``."""
    rows.select("experiment_id", "seed", "status", "detail", "at").write.mode("append").parquet(path)


def read_status(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.groupBy("experiment_id", "seed").agg(F.max_by("status", "at").alias("status"), F.max_by("detail", "at").alias("detail"))
