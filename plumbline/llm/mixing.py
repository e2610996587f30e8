"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.columns import WORD, word_count
from plumbline.llm.storage import cut_lineage

#: Buckets of the seeded order in each source, as leading hexadecimal digits: 4096 buckets.
BUCKET_DIGITS = 3
#: Sources up to which their limits are broadcast.
LIMITS = 100_000


def cycle_weights(weights=(3.0, 1.0, 2.0)):
    """A weight rule: sources in code-point order, null last, take the weights in turn."""
    values = F.array(*[F.lit(float(w)) for w in weights])

    def rule(sources: DataFrame) -> DataFrame:
        order = Window.orderBy(F.col("source").asc_nulls_last())
        turn = ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")
        return sources.withColumn("weight", F.element_at(values, turn))

    return rule


def source_targets(totals: DataFrame, *, share: float = 1.5, max_epochs: float = 2.0, weights=None) -> DataFrame:
    """Targets of ``totals`` (source, source_size), one row per source: adds weight, target.

    The targets share ``share`` times all sizes by weight; none passes ``max_epochs`` times its
    source's size, and what is cut off goes to the others by weight until none is above. That
    fixed point is min(cap, weight * level) for one level, found by cumulative sums over the
    sources in the order in which they reach their caps; only one row per source meets here.
    """
    rows = (weights or cycle_weights())(totals).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "size": F.lit(float(share)) * F.sum("source_size").over(everything),
        }
    )
    # the level if the sources before this one are full; it is right from the first source that it does not fill, and later ones give less
    level = (F.col("size") - F.col("full")) / F.col("open")
    fits = F.when(level * F.col("weight") <= F.col("cap"), level)
    rows = rows.withColumn("level", F.max(fits).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _source_key(source: Column) -> Column:
    """The source as a key that tells null from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")))


def _mixed(docs: DataFrame, size: Column | None, share: float, max_epochs: float, weights, seed: int) -> DataFrame:
    """``mix`` with its working columns: source_key, key, whole and extra."""
    sized = docs.select(docs["doc_id"], docs["source"], (word_count() if size is None else size).alias("size"), _order_key(docs["doc_id"], seed).alias("key"))
    # sizes are counted once; texts take no further part
    sized = cut_lineage(sized.withColumns({"bucket": F.substring("key", 1, BUCKET_DIGITS), "source_key": _source_key(F.col("source"))}))
    buckets = sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"), F.max("source").alias("source"))
    totals = buckets.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size"), F.max("source").alias("source"))
    targets = source_targets(totals.select("source", "source_size"), share=share, max_epochs=max_epochs, weights=weights)
    targets = targets.select(_source_key(F.col("source")).alias("source_key"), "source_size", "target")
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start")).join(targets, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    left = F.col("target") - F.col("whole") * F.col("source_size")
    rows = sized.join(buckets, ["source_key", "bucket"]).withColumns({"whole": whole, "start": start})
    return rows.withColumn("extra", (F.col("size") > 0) & (F.col("start") + F.col("size") / F.lit(2.0) <= left))


def mix(docs: DataFrame, *, size: Column | None = None, share: float = 1.5, max_epochs: float = 2.0, weights=None, seed: int = 42) -> DataFrame:
    """How often the mix repeats each document: doc_id, source, size, source_size, target, repeats, taken.

    A source's target over its size is its number of epochs. Each of its documents is repeated
    floor(epochs) times; the fraction goes, whole documents at a time, to those that come first in
    the source's seeded order (MD5 of seed and doc_id) until the words reach the target, to within
    half a document. Running sums go over 4096 buckets of that order and then inside each bucket,
    so no task holds a source. ``taken`` is size times repeats and never above
    ceil(max_epochs) times size. size defaults to the number of words; null text has none.

    Sources are told apart by code points; null is a source of its own, the last. A source without
    words has target 0. Repeated rows count each. Null ids rank as an empty id. An empty table
    gives an empty result. Columns beside doc_id, source and text are not read.
    """
    rows = _mixed(docs, size, share, max_epochs, weights, seed).withColumn("repeats", F.col("whole") + F.col("extra").cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def repeat_documents(docs: DataFrame, *, size: Column | None = None, share: float = 1.5, max_epochs: float = 2.0, weights=None, seed: int = 42) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` says, with all its columns.

    The documents that get the fraction are those up to some place of their source's order, so one
    row per source, its whole epochs and that place, decides; texts are not shuffled while the
    sources are at most LIMITS. Rows of a source with the same doc_id share the larger number of
    repeats that ``mix`` gives one of them.
    """
    rows = _mixed(docs, size, share, max_epochs, weights, seed)
    limits = rows.groupBy(F.col("source_key").alias("__mix_source")).agg(F.max("whole").alias("__mix_whole"), F.max(F.when(F.col("extra"), F.struct("key", "doc_id"))).alias("__mix_last"))
    limits = cut_lineage(limits)
    there = docs["text"].rlike(WORD) if size is None else size > 0
    place = F.struct(_order_key(docs["doc_id"], seed).alias("key"), docs["doc_id"].alias("doc_id"))
    found = docs.withColumns({"__mix_here": _source_key(docs["source"]), "__mix_there": F.coalesce(there, F.lit(False)), "__mix_place": place})
    found = found.join(F.broadcast(limits) if limits.count() <= LIMITS else limits, F.col("__mix_here") == F.col("__mix_source"))
    extra = F.coalesce(F.col("__mix_there") & (F.col("__mix_place") <= F.col("__mix_last")), F.lit(False))
    found = found.withColumn("__mix_n", F.col("__mix_whole") + extra.cast("long")).where("__mix_n > 0")
    return found.withColumn("__mix_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n")))).select(*docs.columns)
