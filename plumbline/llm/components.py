"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.storage import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Each round hangs a node's larger neighbours on its smallest one and then its smaller ones
    likewise, by aggregates and joins over links only; rounds grow with the logarithm of a
    component's size. A round ends in a checkpoint, and rounds stop once the links stay the same.
    Links with a null end and links of a node to itself are passed over.
    """
    current = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = cut_lineage(current), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("center"), F.least("a", "least").alias("least"))
        stars = both.join(least, F.col("a") == F.col("center")).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = stars.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("center"), "least")
        hung = stars.join(least, F.col("a") == F.col("center")).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        current = cut_lineage(hung.union(least.select("center", "least")).distinct())
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())
