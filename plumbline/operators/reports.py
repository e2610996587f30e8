"""Reports over runs: seed status, means over seeds, deltas, pivots, costs, trial grids and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions.scalars import confusion_counts, mean_std_text, mebibytes, retyped, trial_name

#: Metrics of the table over seeds.
SEED_METRICS = ("test_accuracy", "test_precision", "test_recall", "test_f1", "test_auroc", "test_pr_auc", "test_fpr", "wall_clock_training_seconds", "total_communication_cost_bytes")


def seed_states(grid: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(experiment_id, seed) with state: FAILED if marked so, else COMPLETE with metrics, PARTIAL with anything, MISSING."""
    have = artifacts.groupBy("experiment_id", "seed").agg(*(F.max((F.col("kind") == k).cast("int")).alias(k) for k in ("failed", "metrics")))
    return grid.join(have, ["experiment_id", "seed"], "left").select("experiment_id", "seed", F.when(F.col("failed") == 1, "FAILED").when(F.col("metrics") == 1, "COMPLETE").when(F.col("failed").isNotNull(), "PARTIAL").otherwise("MISSING").alias("state"))


def seed_grid(experiments: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every experiment with every seed; both are short lists."""
    return experiments.select("experiment_id").distinct().crossJoin(F.broadcast(seeds.select("seed").distinct()))


def experiment_status(states: DataFrame) -> DataFrame:
    """experiment_id, n_seeds, n_complete, status over (experiment_id, seed, state)."""
    counts = states.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n_seeds"), *(F.count_if(F.col("state") == s).alias(f"n_{s.lower()}") for s in ("COMPLETE", "FAILED", "PARTIAL")))
    status = F.when(F.col("n_complete") == F.col("n_seeds"), "COMPLETE").when(F.col("n_complete") > 0, "PARTIAL").when(F.col("n_failed") + F.col("n_partial") > 0, "FAILED").otherwise("MISSING")
    return counts.select("experiment_id", "n_seeds", "n_complete", status.alias("status"))


def mean_std(rows: DataFrame, metrics: list[str], *, by=("experiment_id",)) -> DataFrame:
    """Long table: by, metric, n, mean, std (population) and display text; cells that are no numbers do not count."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), retyped(F.col(m).cast("string")).alias("value")) for m in metrics])).alias("m")).select(*by, "m.*")
    out = long.groupBy(*by, "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return out.withColumn("display", mean_std_text("mean", "std"))


def curve_band(rounds: DataFrame, metric: str, *, by=("experiment_id",)) -> DataFrame:
    """Mean and population deviation of a metric by round over seeds."""
    return rounds.groupBy(*by, "round").agg(F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"))


def unaligned_rounds(rounds: DataFrame, *, by=("experiment_id",)) -> DataFrame:
    """Experiments whose seeds have different sets of rounds."""
    per = rounds.groupBy(*by, "seed").agg(F.bit_xor(F.xxhash64("round")).alias("set"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.count_distinct("set", "n").alias("variants")).where("variants > 1").select(*by)


def deltas(metrics: DataFrame, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Treatment less control of each pair (control_id, treatment_id): null unless both are numbers."""
    side = lambda name: metrics.select(F.col("experiment_id").alias(f"{name}_id"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
    both = pairs.join(side("control"), "control_id", "left").join(side("treatment"), "treatment_id", "left")
    return both.select("control_id", "treatment_id", *(e for c in columns for e in (F.col(f"control_{c}"), F.col(f"treatment_{c}"), (F.col(f"treatment_{c}") - F.col(f"control_{c}")).alias(f"delta_{c}"))))


def delta_error(control_std: Column, treatment_std: Column, control_n: Column, treatment_n: Column) -> Column:
    """The propagated deviation of a difference, null unless both sides have more than one seed."""
    return F.when((control_n > 1) & (treatment_n > 1), F.sqrt(control_std * control_std + treatment_std * treatment_std))


def metric_pivot(metrics: DataFrame, metric: str, methods: list[str], *, by: str = "cluster_id", method: str = "method") -> DataFrame:
    """One row per cluster with a column per method."""
    return metrics.groupBy(by).pivot(method, methods).agg(F.max(metric))


def communication_cost(runs: DataFrame) -> DataFrame:
    """Bytes per round and in all of (state_bytes, control_bytes, clients, subclusters, rounds), both ways over each link.

    A flat run has no sub-clusters; control variates are bytes sent along with the state.
    """
    links = F.col("clients") + F.coalesce("subclusters", F.lit(0))
    per = (F.col("state_bytes") + F.coalesce("control_bytes", F.lit(0))) * 2 * links
    return runs.withColumn("bytes_per_round", per).withColumns({"total_bytes": per * F.col("rounds"), "total_mib": mebibytes(per * F.col("rounds"))})


def two_level_loss(losses: DataFrame) -> DataFrame:
    """Mean loss over the clients of a sub-cluster, then the unweighted mean over sub-clusters, by round."""
    return losses.groupBy("round", "subcluster_id").agg(F.avg("loss").alias("loss")).groupBy("round").agg(F.avg("loss").alias("loss"))


def confusion_report(runs: DataFrame, column: str) -> DataFrame:
    """``runs`` with tn, fp, fn, tp of a JSON matrix, and a status that says where it is missing or not two by two."""
    cells = confusion_counts(column)
    return runs.withColumns({"c": cells}).withColumns({n: F.col(f"c.{n}") for n in ("tn", "fp", "fn", "tp")}).withColumn("status", F.when(F.col("c").isNull(), "missing_confusion_matrix").otherwise("ok")).drop("c")


def summary_table(parts: list[DataFrame], preferred: list[str]) -> DataFrame:
    """One table of runs with different columns: the preferred ones that are there, then the others by name."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    first = [c for c in preferred if c in whole.columns]
    return whole.select(*first, *sorted(c for c in whole.columns if c not in first))


def first_tier(found: DataFrame) -> DataFrame:
    """Of (experiment_id, tier, ...) the rows of the lowest tier of each experiment."""
    best = found.groupBy("experiment_id").agg(F.min("tier").alias("tier"))
    return found.join(best, ["experiment_id", "tier"], "left_semi")


def trial_grid(spark: SparkSession, axes: dict[str, list], preferred: dict[str, list] | None = None) -> DataFrame:
    """Every combination of the axes' values with trial_no from 1 and trial_id; the last axis turns fastest.

    Preferred values of an axis come first, the others keep their order.
    """
    out = spark.range(1).select()
    for name, values in axes.items():
        wanted = (preferred or {}).get(name, [])
        ordered = [v for v in wanted if v in values] + [v for v in values if v not in wanted]
        axis = F.array(*[F.struct(F.lit(i).alias(f"__{name}"), F.lit(v).alias(name)) for i, v in enumerate(ordered)])
        out = out.select("*", F.inline(axis))
    number = F.row_number().over(Window.orderBy(*(f"__{n}" for n in axes)))
    return out.withColumn("trial_no", number).select(trial_name("trial_no").alias("trial_id"), "trial_no", *axes)


def open_trials(grid: DataFrame, results: DataFrame, *, start: int = 0, most: int | None = None) -> DataFrame:
    """The trials from the ``start``-th on, ``most`` at most, that have no complete result."""
    part = grid.where((F.col("trial_no") > start) & (F.col("trial_no") <= (start + most if most is not None else 2**31 - 1)))
    return part.join(results.where("status = 'COMPLETE'"), "trial_id", "left_anti")


def best_trial(results: DataFrame) -> DataFrame:
    """The complete trial with the best validation F1, then test F1, lower FPR, fewer seconds; the first of equal ones."""
    keys = F.struct(F.col("val_f1"), F.col("test_f1"), (-F.col("test_fpr")).alias("fpr"), (-F.col("seconds")).alias("seconds"), (-F.col("trial_no")).alias("no"))
    return results.where("status = 'COMPLETE'").agg(F.max_by(F.struct(*results.columns), keys).alias("best")).select("best.*")


def trial_counts(grid: DataFrame, results: DataFrame) -> DataFrame:
    """n_trials, n_attempted, n_complete."""
    joined = grid.select("trial_id").join(results.select("trial_id", "status"), "trial_id", "left")
    return joined.agg(F.count_distinct("trial_id").alias("n_trials"), F.count("status").alias("n_attempted"), F.count_if(F.col("status") == "COMPLETE").alias("n_complete"))


def registry_differences(matrix: DataFrame, registry: DataFrame, fields: list[str], *, key: str = "experiment_id") -> DataFrame:
    """Rows that one side lacks or that differ in a field: key, problem, by a full outer join and null-safe equality."""
    joined = matrix.select(F.col(key), F.lit(True).alias("__in_m"), *(F.col(f).alias(f"__m_{f}") for f in fields)).join(registry.select(F.col(key), F.lit(True).alias("__in_r"), *(F.col(f).alias(f"__r_{f}") for f in fields)), key, "full_outer")
    differing = F.filter(F.array(*[F.when(~F.col(f"__m_{f}").eqNullSafe(F.col(f"__r_{f}")), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    problem = F.when(F.col("__in_m").isNull(), "missing in matrix").when(F.col("__in_r").isNull(), "missing in registry").when(F.size(differing) > 0, F.concat(F.lit("differs: "), F.array_join(differing, ",")))
    return joined.select(key, problem.alias("problem")).where("problem IS NOT NULL")
