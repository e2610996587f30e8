"""Ordered, contiguous shards and their train, validation and test ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.running import counted_positions

#: Shares of training, validation and test rows of a shard.
RATIOS = (0.7, 0.15, 0.15)
SPLITS = ("train", "validation", "test")


class CoverageError(ValueError):
    """A shard or split lacks rows or a class."""


def order_keys(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``frame`` with each key column in its comparable form, as ``key_<name>``.

    A column of numbers only becomes a double; one whose cells all look like 25-Apr-19 becomes
    ISO text; any other its trimmed text. Missing cells are not looked at for that decision.
    """
    from plumbline.functions.scalars import day_key, is_missing, to_number, trimmed

    checks = [f(F.when(~is_missing(c), F.col(c))).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("number", lambda v: F.every(v.isNull() | to_number(v).isNotNull())), ("day", lambda v: F.every(v.isNull() | day_key(v).isNotNull())))]
    found = frame.agg(*checks).first()
    forms = {c: to_number(c) if found[f"number_{i}"] else day_key(c) if found[f"day_{i}"] else trimmed(c) for i, c in enumerate(columns)}
    return frame.withColumns({f"key_{c}": v for c, v in forms.items()})


def usable_order_columns(frame: DataFrame, columns: list[str]) -> list[str]:
    """The key columns that are there and have no missing cell in any file; file order alone if there is none."""
    from plumbline.functions.scalars import is_missing

    present = [c for c in columns if c in frame.columns]
    if not present:
        return []
    gaps = frame.agg(*(F.count_if(is_missing(c)).alias(c) for c in present)).first()
    return [c for c in present if not gaps[c]]


def _start(client: Column, rows: Column, clients: int) -> Column:
    return F.floor(client * rows / F.lit(clients)).cast("long")


def shards(ordered: DataFrame, rows: int | Column, clients: int) -> DataFrame:
    """Rows with ``pos`` dealt into ``clients`` contiguous shards: client (from 0), local_pos, shard_rows.

    Shard i is [i*n div k, (i+1)*n div k); the shard of a row follows from its place alone.
    """
    n, k = F.lit(rows) if isinstance(rows, int) else rows, F.lit(clients)
    client = F.expr(f"(pos + 1) * {clients} - 1").cast("long")
    out = ordered.withColumn("__n", n.cast("long")).withColumn("client", F.floor(client / F.col("__n")).cast("long"))
    start, stop = (F.floor((F.col("client") + i) * F.col("__n") / k).cast("long") for i in (0, 1))
    return out.withColumns({"local_pos": F.col("pos") - start, "shard_rows": stop - start}).drop("__n")


def split_of(local_pos: str | Column = "local_pos", rows: str | Column = "shard_rows", ratios=RATIOS) -> Column:
    """train, validation or test for a row of a shard. Training has at least one row; products are cut, not rounded, as doubles."""
    place, n = (F.col(c) if isinstance(c, str) else c for c in (local_pos, rows))
    train = F.least(n, F.greatest(F.lit(1), F.floor(n * F.lit(float(ratios[0])))))
    validation = F.least(n, F.greatest(train, F.floor(n * F.lit(float(ratios[0] + ratios[1])))))
    return F.when(place < train, "train").when(place < validation, "validation").otherwise("test")


def shard_and_split(frame: DataFrame, order: list[str], clients: int, *, ratios=RATIOS) -> DataFrame:
    """``frame`` in the global order of ``order`` (unique), with pos, client, local_pos, shard_rows and split."""
    ordered, rows = counted_positions(frame, order)
    if rows < clients:
        raise CoverageError(f"{rows} rows cannot fill {clients} shards")
    return shards(ordered, rows, clients).withColumn("split", split_of(ratios=ratios))


def split_counts(split_rows: DataFrame, label: str = "label") -> DataFrame:
    """client, split, rows, negatives, positives, single_class of each shard's splits that have rows."""
    counted = split_rows.groupBy("client", "split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"))
    return counted.withColumn("single_class", (F.col("negatives") == 0) | (F.col("positives") == 0))


def split_rollup(split_rows: DataFrame, label: str = "label") -> DataFrame:
    """The same counts by shard and split, by split, and over all, as one rollup; null marks a total."""
    return split_rows.rollup("split", "client").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 1).alias("positives"))


def check_coverage(split_rows: DataFrame, label: str = "label") -> None:
    """Raise unless every shard has training rows and every split that has rows has both classes over all shards."""
    counts = split_counts(split_rows, label)
    empty = counts.groupBy("client").agg(F.count_if(F.col("split") == "train").alias("n")).where("n = 0").limit(5).collect()
    if empty:
        raise CoverageError(f"shards without training rows: {[r.client for r in empty]}")
    single = counts.groupBy("split").agg(F.sum("negatives").alias("n"), F.sum("positives").alias("p")).where("n = 0 OR p = 0").collect()
    if single:
        raise CoverageError(f"splits with one class only: {sorted(r.split for r in single)}")


def client_metadata(split_rows: DataFrame, cluster: int, label: str = "label") -> DataFrame:
    """One row per shard, nested as it is saved: client_id, start, end, n_rows and splits with label counts."""
    from plumbline.functions.scalars import client_name

    part = split_rows.groupBy("client", "split").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label) == 0).alias("zero"), F.count_if(F.col(label) == 1).alias("one"))
    counts = F.map_from_arrays(F.array(F.lit("0"), F.lit("1")), F.array("zero", "one"))
    part = part.withColumn("piece", F.struct("start", "end", "split", "n_rows", counts.alias("label_counts"), ((F.col("zero") == 0) | (F.col("one") == 0)).alias("single_class")))
    whole = part.groupBy("client").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_rows").alias("n_rows"), F.array_sort(F.collect_list("piece"), lambda a, b: F.signum(a["start"] - b["start"]).cast("int")).alias("splits"))
    return whole.select(client_name(F.lit(cluster), F.col("client") + 1).alias("client_id"), "start", "end", "n_rows", "splits")
