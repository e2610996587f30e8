"""Binary scores: confusion, losses, ranking metrics, thresholds and the best round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.scalars import log_loss
from plumbline.operators.running import running_sums


def confusion(scores: DataFrame, threshold: float | Column = 0.5, *, by=()) -> DataFrame:
    """tn, fp, fn, tp and support of (label, p) rows, a score of at least the threshold being positive."""
    hit, true = F.col("p") >= threshold, F.col("label") == 1
    counts = {"tn": ~true & ~hit, "fp": ~true & hit, "fn": true & ~hit, "tp": true & hit}
    return scores.groupBy(*by).agg(*(F.count_if(c).alias(n) for n, c in counts.items()), F.count(F.lit(1)).alias("support"))


def _ratio(over: Column, under: Column) -> Column:
    return F.coalesce(F.try_divide(over.cast("double"), under.cast("double")), F.lit(0.0))


def rates(counts: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1 and fpr; a division by zero gives 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns({"accuracy": _ratio(tn + tp, tn + fp + fn + tp), "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn)})


def binary_metrics(scores: DataFrame, threshold: float | Column = 0.5, *, by=()) -> DataFrame:
    return rates(confusion(scores, threshold, by=by))


def mean_log_loss(scores: DataFrame, *, by=()) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg(log_loss("p", "label")).alias("log_loss"))


def _by_score(scores: DataFrame, by=()) -> DataFrame:
    return scores.groupBy(*by, "p").agg(F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))


def ranking_metrics(scores: DataFrame, *, by=(), buckets: int | None = None) -> DataFrame:
    """One row, or one for each group of ``by``: auroc and average_precision, exact, null unless both classes are there.

    Equal scores count one half in the area; average precision steps over different scores from
    the top. Rows are first added up by score, so windows see different scores only; all groups are
    one pass.
    """
    steps = running_sums(_by_score(scores, by), ["p"], {"tp": F.col("positives"), "fp": F.col("negatives")}, by=by, descending=True, buckets=buckets)
    # negatives below a score: all of them less those at it and above
    found = steps.groupBy(*by).agg(
        F.sum("positives").alias("n_positive"),
        F.sum("negatives").alias("n_negative"),
        F.sum(F.col("positives") * (F.col("fp") - F.col("negatives") + 0.5 * F.col("negatives").cast("double"))).alias("beaten"),
        F.sum(F.col("positives") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))).alias("area"),
    )
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    pairs = F.col("n_positive").cast("double") * F.col("n_negative")
    return found.select(*by, F.when(both, 1.0 - F.try_divide(F.col("beaten"), pairs)).alias("auroc"), F.when(both, F.try_divide(F.col("area"), F.col("n_positive").cast("double"))).alias("average_precision"), "n_positive", "n_negative")


def best_threshold(scores: DataFrame, *, buckets: int | None = None) -> DataFrame:
    """One row, threshold and f1: the score with the best F1 when at least that score is positive.

    Scores within 1e-8 + 1e-5 * best of the best F1 are equal; of these the one nearest to 0.5
    wins, then the higher one. 0.5 with a null f1 if there are no rows or one class only.
    """
    steps = running_sums(_by_score(scores), ["p"], {"tp": F.col("positives"), "fp": F.col("negatives")}, descending=True, buckets=buckets)
    totals = steps.agg(F.sum("positives").alias("np"), F.sum("negatives").alias("nn"))
    steps = steps.crossJoin(F.broadcast(totals)).where("np > 0 AND nn > 0")  # one row of totals
    steps = steps.withColumn("f1", _ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("np")))
    best = steps.agg(F.max("f1").alias("best"))
    tied = steps.crossJoin(F.broadcast(best)).where("best - f1 <= 1e-8D + 1e-5D * best")
    chosen = tied.select(F.struct((-F.abs(F.col("p") - 0.5)).alias("near"), "p", "f1").alias("c")).agg(F.max("c").alias("c"))
    return chosen.select(F.coalesce("c.p", F.lit(0.5)).alias("threshold"), F.col("c.f1").alias("f1"))


def evaluate(scores: DataFrame) -> DataFrame:
    """Metrics by split of (split, label, p): training at 0.5, validation and test at 0.5 and at the threshold that validation chose.

    Loss and ranking metrics hang on the split alone; they are found once by split and stand beside both rules.
    """
    tuned = best_threshold(scores.where("split = 'validation'")).select(F.col("threshold").alias("tuned"))
    both = scores.crossJoin(F.broadcast(tuned)).select("split", "label", "p", F.explode(F.array(F.struct(F.lit("default").alias("rule"), F.lit(0.5).alias("threshold")), F.struct(F.lit("tuned").alias("rule"), F.col("tuned").alias("threshold")))).alias("r"))
    both = both.select("split", "label", "p", "r.rule", "r.threshold").where("split <> 'train' OR rule = 'default'")
    ranks = ranking_metrics(scores, by=("split",)).select("split", "auroc", "average_precision")
    return rates(confusion(both, F.col("threshold"), by=("split", "rule", "threshold"))).join(mean_log_loss(scores, by=("split",)), "split").join(ranks, "split")


# Names of the round table and the metrics of ``evaluate`` that they show, by split.
_TRAIN_COLUMNS = {"accuracy": "accuracy", "f1": "f1"}
_RATE_COLUMNS = {"accuracy": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1", "auroc": "auroc", "pr_auc": "average_precision", "fpr": "fpr"}
ROUND_COLUMNS = [
    "round", "train_loss_local_mean", *(f"train_{c}" for c in _TRAIN_COLUMNS),
    *(f"{s}_{c}" for s in ("validation", "test") for c in ("loss", *_RATE_COLUMNS)),
    "threshold_used", "communication_cost_bytes", *(f"{s}_{c}_default_threshold" for s in ("validation", "test") for c in _RATE_COLUMNS),
]


def round_row(evaluated: DataFrame, *, by=()) -> DataFrame:
    """The 33 columns of a round's row that come from scores, one row for each group of ``by``.

    ``evaluated`` are rows of ``evaluate``. Validation and test are at the tuned threshold, and at
    0.5 in the columns that say so; a split without rows gives null.
    """

    def of(split: str, rule: str, metric: str) -> Column:
        return F.max(F.when((F.col("split") == split) & (F.col("rule") == rule), F.col(metric)))

    columns = {f"train_{c}": of("train", "default", m) for c, m in _TRAIN_COLUMNS.items()}
    for split in ("validation", "test"):
        columns |= {f"{split}_{c}": of(split, "tuned", m) for c, m in {"loss": "log_loss", **_RATE_COLUMNS}.items()}
        columns |= {f"{split}_{c}_default_threshold": of(split, "default", m) for c, m in _RATE_COLUMNS.items()}
    columns["threshold_used"] = of("validation", "tuned", "threshold")
    return evaluated.groupBy(*by).agg(*(columns[c].alias(c) for c in ROUND_COLUMNS if c in columns))


def best_round(rounds: DataFrame, *, by=("experiment_id",)) -> DataFrame:
    """The round with the largest validation F1 of each experiment, the last of equal ones; rounds without one are passed over."""
    order = Window.partitionBy(*by).orderBy(F.col("val_f1").desc(), F.col("round").desc())
    return rounds.where("val_f1 IS NOT NULL").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
