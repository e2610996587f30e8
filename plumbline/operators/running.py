"""Global order without one task for all rows: positions and running sums over ranges of the keys."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.sources.files import cut_lineage

_RANGE, _PLACE = "__range", "__place"


def _ranged(frame: DataFrame, order: list[str], *, by=(), descending: bool = False, ranges: int | None = None) -> DataFrame:
    """``frame`` dealt by ranges of all keys, each sorted, with the number of the range and the place in it.

    Spark's range exchange finds the bounds; there are as many ranges as shuffle partitions, or
    ``ranges``. The rows are checkpointed, as the exchange would find other bounds when it ran again.
    """
    keys = [*(F.col(c).asc() for c in by), *(F.col(c).desc() if descending else F.col(c).asc() for c in order)]
    dealt = frame.repartitionByRange(ranges, *keys) if ranges else frame.repartitionByRange(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut_lineage(dealt.sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias(_RANGE), place.alias(_PLACE)))


def running_sums(frame: DataFrame, order: list[str], sums: dict[str, Column], *, by=(), descending: bool = False, buckets: int | None = None) -> DataFrame:
    """``frame`` with, for each name in ``sums``, the sum over all rows (of its group, with ``by``) up to and including a row.

    Rows come in the order of the columns ``order``, nulls first, or last if descending. Ranges are
    of all these columns, so that ties in the first one do not fill one, and a group of any size
    lies in as many ranges as it needs. Each range is one window; what comes before it in a group
    is a running sum over one row per range and group. ``buckets`` is a number of ranges.
    """
    rows = _ranged(frame, order, by=by, descending=descending, ranges=buckets)
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    totals = rows.groupBy(*by, _RANGE).agg(*(F.sum(v).alias(f"__total_{n}") for n, v in sums.items()))
    across = Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col(_RANGE).alias("__of"), *(F.coalesce(F.sum(f"__total_{n}").over(across), F.lit(0)).alias(f"__start_{n}") for n in sums))
    same = [F.col(_RANGE) == F.col("__of"), *(F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by)]
    inside = Window.partitionBy(_RANGE, *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: F.sum(v).over(inside) for n, v in sums.items()}).join(starts if by else F.broadcast(starts), same)
    return rows.withColumns({n: F.col(f"__start_{n}") + F.col(n) for n in sums}).select(*frame.columns, *sums)


def counted_positions(frame: DataFrame, order: list[str], *, name: str = "pos", buckets: int | None = None) -> tuple[DataFrame, int]:
    """``positions`` and the number of rows.

    A row's position is the number of rows in the ranges before its own, which the driver adds up
    over one number per range, and its place in there; no window and no further exchange is needed.
    """
    rows = _ranged(frame, order, ranges=buckets)
    sizes = sorted(rows.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("n")).collect())
    starts = list(accumulate((r.n for r in sizes), initial=0))
    known = rows.sparkSession.createDataFrame([(r[_RANGE], start) for r, start in zip(sizes, starts[:-1], strict=True)], f"{_RANGE} int, __start long")
    found = rows.join(F.broadcast(known), _RANGE).withColumn(name, F.col("__start") + F.col(_PLACE))
    return found.select(*(c for c in frame.columns if c != name), name), starts[-1]


def positions(frame: DataFrame, order: list[str], *, name: str = "pos", buckets: int | None = None) -> DataFrame:
    """``frame`` with the place of each row from 0 in the order of ``order``, which must be unique."""
    return counted_positions(frame, order, name=name, buckets=buckets)[0]
