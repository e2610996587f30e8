"""Model state as a long table (owner, key, idx, value): weighted means, batch-norm rules, control variates."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scalars import is_batch_norm


class AggregationError(ValueError):
    """Updates that must not be averaged."""


def check_updates(updates: DataFrame, *, cluster: int | None = None) -> None:
    """Raise unless updates (cluster_id, contributor, n, key, idx, value) are there, of one cluster, with positive whole weights and equal keys."""
    per = updates.groupBy("cluster_id", "contributor").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.bit_xor(F.xxhash64("key", "idx")).alias("keys"), F.count(F.lit(1)).alias("size"))
    found = per.agg(F.count(F.lit(1)).alias("n"), F.min("cluster_id").alias("low"), F.max("cluster_id").alias("high"), F.min("least").alias("weight"), F.count_if(F.col("most") != F.col("least")).alias("mixed"), F.count_distinct("keys", "size").alias("keysets")).first()
    if not found.n:
        raise AggregationError("no updates to average")
    if found.low != found.high or (cluster is not None and found.low != cluster):
        raise AggregationError("updates of different clusters must not be averaged")
    if found.weight is None or found.weight <= 0 or found.mixed:
        raise AggregationError("each contributor needs one positive number of samples")
    if found.keysets != 1:
        raise AggregationError("contributors have different state keys")


def weighted_mean(updates: DataFrame, *, by=("parent",), batch_norm: bool = True) -> DataFrame:
    """The mean of each element by number of samples: by, key, idx, value and the samples of a parent, n.

    One aggregate with partial sums in each task. Without ``batch_norm`` keys of batch
    normalisation are left out.
    """
    rows = updates if batch_norm else updates.where(~is_batch_norm("key"))
    sums = rows.groupBy(*by, "key", "idx").agg(F.sum(F.col("value").cast("double") * F.col("n")).alias("__sum"), F.sum("n").alias("n"))
    return sums.select(*by, "key", "idx", (F.col("__sum") / F.col("n")).alias("value"), "n")


def two_level_mean(updates: DataFrame, *, batch_norm: bool = True) -> DataFrame:
    """Means by sub-cluster, then over sub-clusters by their samples: cluster_id, key, idx, value, n."""
    lower = weighted_mean(updates, by=("cluster_id", "subcluster_id"), batch_norm=batch_norm)
    return weighted_mean(lower, by=("cluster_id",), batch_norm=batch_norm)


def vector_mean(updates: DataFrame, *, by=("parent",), batch_norm: bool = True) -> DataFrame:
    """``weighted_mean`` of updates whose ``value`` is the whole array of a key: by, key, value, n.

    One aggregate over vectors, of which each task sends one per parent and key, so what is
    shuffled hangs on the parents and not on the contributors or the elements. Keys without
    elements are left out.
    """
    rows = (updates if batch_norm else updates.where(~is_batch_norm("key"))).where(F.size("value") > 0)
    mean = Summarizer.metrics("mean").summary(array_to_vector("value"), F.col("n").cast("double"))
    means = rows.groupBy(*by, "key").agg(mean.alias("__of"), F.sum("n").alias("n"))
    return means.select(*by, "key", vector_to_array("__of.mean").alias("value"), "n")


def two_level_vector_mean(updates: DataFrame, *, batch_norm: bool = True) -> DataFrame:
    """``two_level_mean`` of vectors: cluster_id, key, value, n."""
    lower = vector_mean(updates, by=("cluster_id", "subcluster_id"), batch_norm=batch_norm)
    return vector_mean(lower, by=("cluster_id",), batch_norm=batch_norm)


def vector_sum(vectors: DataFrame, *, by=()) -> DataFrame:
    """Sums of arrays by key: by, key, value."""
    sums = vectors.where(F.size("value") > 0).groupBy(*by, "key").agg(Summarizer.metrics("sum").summary(array_to_vector("value")).alias("__of"))
    return sums.select(*by, "key", vector_to_array("__of.sum").alias("value"))


def elements(vectors: DataFrame, *columns: str) -> DataFrame:
    """One row per element of ``value``: the columns, key, idx, value."""
    return vectors.select(*columns, "key", F.posexplode("value").alias("idx", "value"))


def merge_state(shared: DataFrame, local: DataFrame) -> DataFrame:
    """(key, idx, value) of ``shared``, with batch-norm keys from ``local`` where it has them."""
    own = local.where(is_batch_norm("key")).select("key", "idx", F.col("value").alias("__own"))
    return shared.join(own, ["key", "idx"], "left").select("key", "idx", F.coalesce("__own", "value").alias("value"))


def replace_state(reference: DataFrame, updates: DataFrame) -> DataFrame:
    """(key, idx, value) of ``reference``, with the other keys from ``updates`` where it has them."""
    new = updates.where(~is_batch_norm("key")).select("key", "idx", F.col("value").alias("__new"))
    return reference.join(new, ["key", "idx"], "left").select("key", "idx", F.coalesce("__new", "value").alias("value"))


def zero_state(state: DataFrame) -> DataFrame:
    return state.select("key", "idx", F.lit(0.0).alias("value"))


def sum_states(states: DataFrame, *, by=()) -> DataFrame:
    return states.groupBy(*by, "key", "idx").agg(F.sum(F.col("value").cast("double")).alias("value"))


def server_control(control: DataFrame, deltas: DataFrame, clients: int) -> DataFrame:
    """The server's control variate plus the summed changes over the number of all leaf clients."""
    if clients <= 0:
        raise AggregationError("the number of clients must be positive")
    total = sum_states(deltas).select("key", "idx", F.col("value").alias("__delta"))
    return control.join(total, ["key", "idx"], "left").select("key", "idx", (F.col("value") + F.coalesce("__delta", F.lit(0.0)) / F.lit(float(clients))).alias("value"))


def proximal_penalty(state: DataFrame, reference: DataFrame, mu: float, *, by=()) -> DataFrame:
    """mu / 2 times the squared distance of two states."""
    base = reference.select("key", "idx", F.col("value").alias("__base"))
    return state.join(base, ["key", "idx"]).groupBy(*by).agg((F.lit(mu / 2.0) * F.sum(F.pow(F.col("value") - F.col("__base"), F.lit(2.0)))).alias("penalty"))


def l2_norm(state: DataFrame, *, by=()) -> DataFrame:
    return state.groupBy(*by).agg(F.sqrt(F.sum(F.pow(F.col("value").cast("double"), F.lit(2.0)))).alias("l2_norm"))


def state_bytes(state: DataFrame, *, by=()) -> DataFrame:
    """Bytes of a state at four per element: all, and without batch-norm keys."""
    return state.groupBy(*by).agg((4 * F.count(F.lit(1))).alias("all_bytes"), (4 * F.count_if(~is_batch_norm("key"))).alias("shared_bytes"))
