"""Imputation, scaling, one-hot blocks and count windows, fitted on training rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.scalars import category, logit_gradient, one_hot
from plumbline.operators import running

#: Categories from which on a column is dropped.
MOST_CATEGORIES = 20


@dataclass(frozen=True)
class NumericFit:
    """Kept features with what transforms them, and why others were dropped."""

    kept: dict[str, tuple[float, float, float]]
    dropped: dict[str, str]


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exact median of each double column with a value, the mean of the middle two if there is no single one; null is missing, NaN the largest.

    All columns are one pass: rows of column and value, their counts, and running sums of these by
    ranges, so no task holds all different values and the number of jobs is that of one column.
    """
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = rows.select(cells).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    steps = running.running_sums(counts, ["value"], {"upto": F.col("n")}, by=("column",))
    sizes = steps.groupBy("column").agg(F.max("upto").alias("all"))
    middle = [F.min(F.when(F.col("upto") > F.expr(place), F.col("value"))).alias(name) for name, place in (("low", "(all - 1) div 2"), ("high", "all div 2"))]
    found = steps.join(F.broadcast(sizes), "column").groupBy("column").agg(*middle).collect()  # a row per column
    return {r.column: r.low if r.low == r.high else r.low * 0.5 + r.high * 0.5 for r in found}


def median(rows: DataFrame, column: str) -> float | None:
    """The median of one column, None without a value."""
    return medians(rows, [column]).get(column)


def fit_numeric(rows: DataFrame, features: list[str], *, position: str = "pos") -> NumericFit:
    """Median, mean and population standard deviation of each double column; null is missing.

    All-missing columns are dropped, and those whose values are close to the first one in order of
    position: within 1e-8 + 1e-5 * abs(first). The mean is of the imputed column. One aggregate
    over the rows finds first values, a second one the rest, and ``medians`` all medians, for all
    columns side by side.
    """
    if not features:
        return NumericFit({}, {})
    one = rows.agg(*(e for i, f in enumerate(features) for e in (F.min_by(f, F.when(F.col(f).isNotNull(), F.col(position))).alias(f"x{i}"), F.min_by(F.col(f).isNull(), position).alias(f"n{i}")))).first()
    middle = medians(rows, features)
    there = {f: i for i, f in enumerate(features) if f in middle}
    dropped = {f: "all_missing" for f in features if f not in there}
    if not there:
        return NumericFit({}, dropped)
    filled = {f: F.coalesce(F.col(f), F.lit(middle[f])) for f, i in there.items()}
    # the first value counts after imputation
    first = {f: middle[f] if one[f"n{i}"] else one[f"x{i}"] for f, i in there.items()}
    two = rows.agg(*(e for f, i in there.items() for e in (F.avg(filled[f]).alias(f"a{i}"), F.stddev_pop(filled[f]).alias(f"s{i}"), F.max(F.abs(filled[f] - F.lit(first[f]))).alias(f"d{i}")))).first()
    kept = {}
    for f, i in there.items():
        if two[f"d{i}"] <= 1e-8 + 1e-5 * abs(first[f]) or not two[f"s{i}"]:
            dropped[f] = "near_constant"
        else:
            kept[f] = (middle[f], two[f"a{i}"], two[f"s{i}"])
    return NumericFit(kept, dropped)


def scaled(feature: str, median: float, mean: float, scale: float) -> Column:
    """The imputed, standardised feature in single precision."""
    return ((F.coalesce(F.col(feature), F.lit(median)) - F.lit(mean)) / F.lit(scale)).cast("float")


def fit_categories(rows: DataFrame, features: list[str], *, most: int = MOST_CATEGORIES) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Sorted categories of each text column, missing cells being UNKNOWN; columns with one or more than ``most`` are dropped.

    Each task keeps the different values only; a column stops counting at ``most`` + 1 of them, by
    an approximate count first, so that no column of free text is gathered.
    """
    if not features:
        return {}, {}
    rough = rows.agg(*(F.approx_count_distinct(category(f)).alias(f) for f in features)).first()
    few = [f for f in features if rough[f] <= 2 * most + 10]
    dropped = {f: "too_many_categories" for f in features if f not in few}
    kept: dict[str, list[str]] = {}
    found = rows.agg(*(F.sort_array(F.collect_set(category(f))).alias(f) for f in few)).first() if few else {}
    for f in few:
        values = found[f]
        if len(values) <= 1:
            dropped[f] = "single_category"
        elif len(values) > most:
            dropped[f] = "too_many_categories"
        else:
            kept[f] = sorted(values)
    return kept, dropped


def feature_names(numeric: NumericFit, categories: dict[str, list[str]]) -> list[str]:
    return [*numeric.kept, *(f"{f}={v}" for f, values in categories.items() for v in values)]


def transform(rows: DataFrame, numeric: NumericFit, categories: dict[str, list[str]], *, name: str = "features") -> DataFrame:
    """``rows`` with an array of scaled features followed by the one-hot blocks. An unseen category gives zeros."""
    blocks = [F.array(*[scaled(f, *fit) for f, fit in numeric.kept.items()])] if numeric.kept else []
    blocks += [one_hot(category(f), values) for f, values in categories.items()]
    if not blocks:
        raise ValueError("no usable features")
    return rows.withColumn(name, F.concat(*blocks))


def fit_and_transform(rows: DataFrame, numeric: list[str], text: list[str], *, scope: str = "train") -> DataFrame:
    """``rows`` (with pos and, for scope ``train``, split) with features fitted on training rows or, for ``all``, on every row."""
    base = rows.where("split = 'train'") if scope == "train" else rows
    fit = fit_numeric(base, numeric)
    return transform(rows, fit, fit_categories(base, text)[0])


def _placed(rows: DataFrame, width: int, by, order: str) -> DataFrame:
    """Rows of groups that have a full window, with __place, their place in the group, and __size, its rows. ``order`` counts the rows of a group without gaps.

    Where groups begin is broadcast; there is a row for each shard and split, a number that the
    settings of a run give and not its input.
    """
    groups = rows.groupBy(*by).agg(F.min(order).alias("__first"), F.count(F.lit(1)).alias("__size")).where(F.col("__size") >= width)
    return rows.join(F.broadcast(groups), list(by)).withColumn("__place", F.col(order) - F.col("__first"))


def _in_windows(rows: DataFrame, width: int, stride: int, pane: int = 1) -> DataFrame:
    """Each row of ``_placed``, or each pane of as many rows, once for each full window that has it, with window_no.

    A row knows its windows from its place, so rows meet by window and not by group: a shard's
    split may be of any size.
    """
    # numerators below 0 are of the first window's rows
    low = F.when(F.col("__place") < width, F.lit(0).cast("long")).otherwise(F.expr(f"(__place + {pane} - {width} + {stride} - 1) div {stride}"))
    high = F.least(F.expr(f"__place div {stride}"), F.expr(f"(__size - {width}) div {stride}"))
    return rows.withColumns({"__low": low, "__high": high}).where("__low <= __high").withColumn("window_no", F.explode(F.sequence("__low", "__high")))


def window_labels(rows: DataFrame, *, width: int, stride: int, by=("client", "split"), order: str = "local_pos", label: str = "label") -> DataFrame:
    """Full count windows inside each shard's split: start_pos, window_no and label, 1 if any row of the window has 1.

    Windows start at every ``stride``-th row of the split; their number is (n - width) div stride + 1.
    Rows are added up once, by panes that windows are made of whole (their length divides width
    and stride), where the rows are; only panes are copied to the windows that overlap.
    """
    pane = math.gcd(width, stride)
    placed = _placed(rows.select(*by, order, label), width, by, order).withColumn("__pane", F.expr(f"__place div {pane}"))
    panes = placed.groupBy(*by, "__pane").agg(F.min(order).alias(order), F.max(label).alias(label), F.min("__place").alias("__place"), F.first("__size").alias("__size"))
    out = _in_windows(panes, width, stride, pane).groupBy(*by, "window_no").agg(F.min(order).alias("start_pos"), F.max(label).cast("int").alias("window_label"))
    return out.select(*by, "start_pos", "window_no", "window_label")


def window_features(rows: DataFrame, *, width: int, stride: int, by=("client", "split"), order: str = "local_pos", label: str = "label", features: str = "features") -> DataFrame:
    """The windows themselves, features first: a matrix of one row per feature and one column per row of the window."""
    out = _in_windows(_placed(rows.select(*by, order, label, features), width, by, order), width, stride)
    out = out.groupBy(*by, "window_no").agg(F.min(order).alias("start_pos"), F.max(label).cast("int").alias("window_label"), F.sort_array(F.collect_list(F.struct(order, features))).alias("__rows"))
    turned = F.transform(F.sequence(F.lit(0), F.size(F.get("__rows", F.lit(0))[features]) - 1), lambda i: F.transform("__rows", lambda r: F.get(r[features], i)))
    return out.select(*by, "start_pos", turned.alias("window"), "window_label")


def too_short(rows: DataFrame, *, width: int, by=("client", "split")) -> DataFrame:
    """The splits with rows but too few for one window."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") < width)


def capped(rows: DataFrame, limit: int, *, by=("client", "split"), order: str = "local_pos") -> DataFrame:
    """The first ``limit`` rows of each group in order."""
    each = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(each)).where(F.col("__n") <= limit).drop("__n")


def class_weight(rows: DataFrame, label: str = "label") -> DataFrame:
    """One row: negatives, positives and their quotient, null unless both classes are there."""
    counts = rows.agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"))
    both = (F.col("negatives") > 0) & (F.col("positives") > 0)
    return counts.withColumn("positive_weight", F.when(both, F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double"))))


def linear_step(rows: DataFrame, weights: dict[str, float], bias: float, *, label: str = "label", rate: float = 0.05, positive_weight: float = 1.0) -> DataFrame:
    """key and value of a linear model after one step of gradient descent over all rows; ``weights`` are by feature column.

    The gradient is one aggregate, summed where the rows are before anything is shuffled.
    """
    logit = sum((F.col(f) * F.lit(w) for f, w in weights.items()), F.lit(bias))
    slope = logit_gradient(logit, label, positive_weight)
    means = rows.withColumn("__slope", slope).agg(*(F.avg(F.col("__slope") * F.col(f)).alias(f) for f in weights), F.avg("__slope").alias("bias"))
    stepped = [F.struct(F.lit(k).alias("key"), (F.lit(w) - F.lit(rate) * F.col(k)).alias("value")) for k, w in {**weights, "bias": bias}.items()]
    return means.select(F.inline(F.array(*stepped)))
