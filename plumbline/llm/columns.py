"""Column expressions that several corpus operators share."""

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has at least this share of all rows, so there are at most 1/share hot keys.
HOT_SHARE = 0.001
#: Values of a column whose counts may be broadcast.
FEW_VALUES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(text: str | Column = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: str = "text") -> Column:
    """Number of words of a text as a long; 0 for null."""
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def join_weighted(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join of ``rows`` (with doc_id) to ``table``, one row per key, whose ``weight`` is the number of rows of a key.

    The hot keys, 1/HOT_SHARE at most, are broadcast. Rows that they match get a last key for the
    shuffle join that matches nothing and spreads them, so no partition holds a hot key. The last
    key is a digest in text form, which no number is.
    """
    *firsts, last = keys
    values = [c for c in table.columns if c not in keys]
    hot = table.where(F.col(weight) >= F.lit(total * HOT_SHARE)).select(*keys, *(F.col(c).alias(f"__hot_{c}") for c in values))
    rest = table.where(F.col(weight) < F.lit(total * HOT_SHARE)).select(*(F.col(c).alias(f"__rest_{c}") for c in table.columns))
    found = rows.join(F.broadcast(hot), keys, "left")
    spread = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = found.withColumn("__spread", F.when(F.col(f"__hot_{weight}").isNull(), F.col(last)).otherwise(spread))
    on = [F.col("__spread") == F.col(f"__rest_{last}"), *(F.col(k) == F.col(f"__rest_{k}") for k in firsts)]
    found = found.join(rest, on, "left").withColumns({c: F.coalesce(f"__hot_{c}", f"__rest_{c}") for c in values})
    return found.select(*rows.columns, *values)


def first_by_hash(rows: DataFrame, key: str, sample: int, *, most: int | None = 50) -> DataFrame:
    """Up to ``sample`` rows of each of the ``most`` most frequent values of ``key``, those that come first by a hash of doc_id.

    A count of each value sets a bound on the hash below which lie about twice as many rows as are
    wanted; only these are shuffled, so what meets in one task does not grow with the input. The
    counts are broadcast: ``most`` rows, or without it all values if they are FEW_VALUES at most;
    beyond that the rows are shuffled by value. ``doc_id`` and ``key`` must not be null.
    """
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__fh_n"))
    if most is not None:
        counts = counts.orderBy(F.desc("__fh_n"), key).limit(most)
    if most is not None or counts.count() <= FEW_VALUES:
        counts = F.broadcast(counts)
    chance = F.xxhash64("doc_id")
    place = chance.cast("double") / F.lit(2.0**64) + F.lit(0.5)
    near = rows.join(counts, key).where(place * F.col("__fh_n") <= F.lit(2.0 * sample + 100))
    order = Window.partitionBy(key).orderBy(chance, "doc_id")
    return near.withColumn("__fh_turn", F.row_number().over(order)).where(F.col("__fh_turn") <= sample).select(*rows.columns)
