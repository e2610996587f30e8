"""Streaming forms of batch operators: event-time counts, and an append-only ledger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators import ledger


def label_counts(events: DataFrame, *, time: str = "ts", label: str = "label", width: str = "1 hour", late: str = "10 minutes", by=()) -> DataFrame:
    """Rows and positives by tumbling event-time window; rows later than ``late`` are dropped once a window is closed."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 1).alias("positives"))
    return counted.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_rows", "positives")


def watch_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The records of a ledger folder as a stream, as they are appended."""
    return spark.readStream.schema(ledger.SCHEMA).json(path)


def alarms(records: DataFrame) -> DataFrame:
    """The records of a stream that break a rule of the ledger."""
    return ledger.violations(records)


def _checked(frames: Iterator[pd.DataFrame], last: tuple[int, str] | None) -> tuple[pd.DataFrame, tuple[int, str] | None]:
    """The records of one cluster that do not follow on the record before them, and the last round with its hash."""
    rows = pd.concat([*frames]).sort_values("round_id", kind="stable")
    before, round_before = rows["new_main_model_hash"].shift(), rows["round_id"].shift()
    if last:
        round_before.iloc[0], before.iloc[0] = last
    follows = rows["round_id"] > round_before.fillna(0)
    linked = (rows["previous_main_model_hash"] == before) | (rows["previous_main_model_hash"].isna() & before.isna())
    found = rows.assign(expected=before, reason=[None if a and b else "broken link" if a else "late or repeated round" for a, b in zip(follows, linked, strict=True)])
    kept = rows[follows]  # a late record does not change what comes after it
    if len(kept):
        last = (int(kept["round_id"].iloc[-1]), kept["new_main_model_hash"].iloc[-1])
    return found[found["reason"].notna()], last


def broken_chain(records: DataFrame) -> DataFrame:
    """The records of a ledger's stream that break the chain: cluster_id, round_id, previous_main_model_hash, expected, reason.

    State by cluster is the last round and its hash, so a record is checked against the one before
    it, whichever micro-batch brought that. Records of a micro-batch are put in order of their
    rounds; one whose round is not after the last one's is reported as late or repeated.
    """
    columns = ["cluster_id", "round_id", "previous_main_model_hash", "new_main_model_hash"]
    schema = "cluster_id int, round_id int, previous_main_model_hash string, expected string, reason string"

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        found, last = _checked(frames, tuple(state.get) if state.exists else None)
        if last:
            state.update(last)
        yield found[["cluster_id", "round_id", "previous_main_model_hash", "expected", "reason"]]

    return records.select(*columns).groupBy("cluster_id").applyInPandasWithState(check, schema, "round_id int, hash string", "append", GroupStateTimeout.NoTimeout)
