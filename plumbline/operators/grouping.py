"""Shard descriptors, their standardisation, and frozen groups by Ward clustering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.hashing import membership_sha256
from plumbline.functions.scalars import client_number


class MembershipError(ValueError):
    """A membership that contradicts itself or what is expected of it."""


def descriptors(rows: DataFrame, features: list[str], *, by: str = "client") -> DataFrame:
    """One row per shard: mean and population standard deviation of every feature over its rows, as ``mean_f`` and ``std_f``."""
    return rows.groupBy(by).agg(*(F.avg(f).alias(f"mean_{f}") for f in features), *(F.stddev_pop(f).alias(f"std_{f}") for f in features))


def standardised(table: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores over all rows of a table of shards; a column without spread is only centred."""
    everything = Window.partitionBy()
    return table.withColumns({c: (F.col(c) - F.avg(c).over(everything)) / F.coalesce(F.nullif(F.stddev_pop(c).over(everything), F.lit(0.0)), F.lit(1.0)) for c in columns})


def ward(points: np.ndarray, k: int) -> list[int]:
    """Labels of Ward clustering into k groups, numbered by first appearance. For the few shards of a cluster.

    Each merge costs size_a * size_b / (size_a + size_b) times the squared distance of the means;
    the cheapest goes first, the first pair on ties.
    """
    if not 1 <= k <= len(points):
        raise MembershipError(f"{len(points)} shards cannot form {k} groups")
    groups = [([i], np.asarray(p, dtype=float)) for i, p in enumerate(points)]
    while len(groups) > k:
        costs = [(len(a) * len(b) / (len(a) + len(b)) * float(((x - y) ** 2).sum()), i, j) for i, (a, x) in enumerate(groups) for j, (b, y) in enumerate(groups[:i])]
        _, i, j = min(costs)
        (a, x), (b, y) = groups[i], groups[j]
        groups[j] = (a + b, (len(a) * x + len(b) * y) / (len(a) + len(b)))
        del groups[i]
    labels = [0] * len(points)
    for number, (members, _) in enumerate(sorted(groups, key=lambda g: min(g[0]))):
        for m in members:
            labels[m] = number
    return labels


def group_shards(table: DataFrame, columns: list[str], k: int, group_ids: list[str], *, by: str = "client") -> DataFrame:
    """(client, subcluster_id) by Ward over a table of shards; groups take ``group_ids`` in the order of their smallest shard."""
    rows = standardised(table, columns).orderBy(by).select(by, *columns).collect()
    labels = ward(np.array([[r[c] for c in columns] for r in rows]), k)
    return table.sparkSession.createDataFrame([(r[by], group_ids[g]) for r, g in zip(rows, labels, strict=True)], f"{by} long, subcluster_id string")


def relabelled(groups: DataFrame, group_ids: list[str]) -> DataFrame:
    """(client_id, raw) with subcluster_id: raw groups ordered by their smallest client number take ``group_ids`` in turn."""
    first = groups.groupBy("raw").agg(F.min(client_number("client_id")).alias("first"))
    ids = F.array(*[F.lit(i) for i in group_ids])
    named = first.select("raw", F.element_at(ids, F.row_number().over(Window.orderBy("first"))).alias("subcluster_id"))
    return groups.join(F.broadcast(named), "raw")


def membership_record(members: list[tuple[str, str]], *, cluster: int, dataset: str, group_ids: list[str], reuse: list[str]) -> dict:
    """The frozen membership as it is saved, with the digest of its client list."""
    clients = [{"client_id": c, "subcluster_id": g} for c, g in members]
    groups = [{"subcluster_id": g, "client_ids": [c for c, h in members if h == g]} for g in group_ids]
    return {"cluster_id": cluster, "dataset": dataset, "n_subclusters": len(group_ids), "fixed_subcluster_ids": group_ids, "frozen": True, "membership_hash": membership_sha256(clients), "subclusters": groups, "clients": clients, "reuse_for_experiment_groups": reuse}


def read_membership(spark: SparkSession, path: str, *, cluster: int, groups: int, expected: DataFrame | None = None, reuse=("B", "P")) -> DataFrame:
    """(client_id, subcluster_id) of a saved membership, after checking it against itself and the ``expected`` client_id column."""
    text = spark.read.option("multiLine", True).json(path).first()
    if text.cluster_id != cluster or not text.frozen or text.n_subclusters != groups or len(text.fixed_subcluster_ids) != groups:
        raise MembershipError("cluster, frozen flag or number of groups differ")
    if not set(reuse) <= set(text.reuse_for_experiment_groups or []):
        raise MembershipError(f"membership must be reused for {', '.join(reuse)}")
    rows = spark.createDataFrame([(c.client_id, c.subcluster_id) for c in text.clients], "client_id string, subcluster_id string")
    nested = [(c, g.subcluster_id) for g in text.subclusters for c in g.client_ids]
    ids = [g.subcluster_id for g in text.subclusters]
    if len(set(ids)) != len(ids) or set(ids) != set(text.fixed_subcluster_ids) or any(not g.client_ids for g in text.subclusters):
        raise MembershipError("groups are empty, repeated or other than the fixed ones")
    if sorted(nested) != sorted((r.client_id, r.subcluster_id) for r in rows.collect()) or len({c for c, _ in nested}) != len(nested):
        raise MembershipError("a client must be in exactly one group, the same in both tables")
    if expected is not None and key_differences(rows, expected, "client_id").limit(1).collect():
        raise MembershipError("clients differ from the expected ones")
    return rows


def key_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: key, side."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))
