"""From a contract to scored runs: examples, frozen groups, training, tables, ledger, trials and comparisons."""

from __future__ import annotations

import time
import traceback
import uuid
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.hashing import canonical_sha256
from plumbline.functions.scalars import client_name
from plumbline.operators import features, federated, grouping, ledger, reports, scoring, sharding
from plumbline.sources import sinks
from plumbline.sources.contract import Contract
from plumbline.sources.csv_tables import FILE, ROW, training_table
from plumbline.sources.files import publish, remove


@dataclass(frozen=True)
class Window:
    """Count windows of an ordered series; without one, each row is an example."""

    width: int
    stride: int


def sharded_features(spark: SparkSession, contract: Contract) -> tuple[DataFrame, list[str]]:
    """The contract's rows in order, in shards and splits, with features fitted on training rows, and the features' names.

    Order is by the contract's usable keys, then file and row; files as they are if no key is usable.
    """
    rows, numeric, text = training_table(spark, contract)
    keys = sharding.usable_order_columns(rows, list(contract.order))
    rows = sharding.order_keys(rows, keys) if keys else rows
    split = sharding.shard_and_split(rows, [*(f"key_{k}" for k in keys), FILE, ROW], contract.clients, ratios=contract.ratios)
    sharding.check_coverage(split)
    train = split.where("split = 'train'")
    fit, (categories, _) = features.fit_numeric(train, numeric), features.fit_categories(train, text)
    return features.transform(split, fit, categories), features.feature_names(fit, categories)


def examples(shards: DataFrame, window: Window | None = None, cap: int | None = None) -> DataFrame:
    """client, split, example, features (channels by length) and label; at most ``cap`` of each shard's split, in order."""
    if window:
        out = features.window_features(shards, width=window.width, stride=window.stride).select("client", "split", F.col("start_pos").alias("example"), F.col("window").alias("features"), F.col("window_label").alias("label"))
    else:
        out = shards.select("client", "split", F.col("local_pos").alias("example"), F.transform("features", lambda x: F.array(x)).alias("features"), F.col("label").cast("int").alias("label"))
    return features.capped(out, cap, order="example") if cap else out


def form_groups(shards: DataFrame, names: list[str], k: int, group_ids: list[str]) -> DataFrame:
    """(client, subcluster_id) of the shards by Ward over means and deviations of their training features."""
    train = shards.where("split = 'train'").select("client", *(F.get("features", F.lit(i)).cast("double").alias(f"f{i}") for i in range(len(names))))
    columns = [f"f{i}" for i in range(len(names))]
    table = grouping.descriptors(train, columns)
    return grouping.group_shards(table, [f"{k_}_{c}" for k_ in ("mean", "std") for c in columns], k, group_ids)


@dataclass(frozen=True)
class Run:
    """One experiment: what trains, for how long, flat or by groups."""

    experiment_id: str
    cluster_id: int
    training: federated.Training
    rounds: int
    hierarchical: bool = True


def run_experiment(data: DataFrame, run: Run, output: str) -> dict:
    """Train and score a run on examples with subcluster_id, and write its rounds, predictions, ledger and status under ``output``.

    Rounds and predictions are written to a staging folder, read again and compared with what they
    should have, and only then renamed to their places; the status row that says COMPLETE comes last.
    """
    spark, began = data.sparkSession, time.perf_counter()
    weight = features.class_weight(data.where("split = 'train'")).first().positive_weight
    if weight is None:
        raise sharding.CoverageError("training examples have one class only")
    training = replace(run.training, positive_weight=weight)
    metrics, last, own = federated.run_rounds(data, training, run.rounds, hierarchical=run.hierarchical)
    kinds = {"round": "int", "communication_cost_bytes": "long"}
    rows = [(run.experiment_id, training.seed, *(m[c] for c in scoring.ROUND_COLUMNS)) for m in metrics]
    rounds = spark.createDataFrame(rows, ", ".join(["experiment_id string", "seed int", *(f"{c} {kinds.get(c, 'double')}" for c in scoring.ROUND_COLUMNS)]))
    # the names that reports and comparisons read
    rounds = rounds.withColumns({"train_loss": F.col("train_loss_local_mean"), "val_f1": F.col("validation_f1"), "threshold": F.col("threshold_used")})
    base = f"{output}/{run.experiment_id}/seed_{training.seed}"
    staged = f"{base}/.staged-{uuid.uuid4().hex}"
    sinks.write_csv(rounds, f"{staged}/round_metrics")
    best = scoring.best_round(rounds).first()
    scores = federated.predictions(data, training.network, last, own).withColumns({"experiment_id": F.lit(run.experiment_id), "seed": F.lit(training.seed)})
    sinks.write_predictions(scores, f"{staged}/predictions")
    check_written(spark, staged, data, run)
    for name in ("round_metrics", "predictions"):
        publish(f"{staged}/{name}", f"{base}/{name}")
    remove(staged)
    groups = data.select("client", "subcluster_id").distinct()
    sizes = data.where("split = 'train'").groupBy("client").count().agg(F.count(F.lit(1)).alias("clients"), F.sum("count").alias("samples")).first()
    write_ledger(spark, run, metrics, f"{output}/{run.experiment_id}/ledger", clients=sizes.clients, samples=sizes.samples, groups=groups)
    summary = {"experiment_id": run.experiment_id, "seed": training.seed, "best_round": best["round"] if best else None, "val_f1": best.val_f1 if best else None, "test_f1": best.test_f1 if best else None, "test_fpr": best.test_fpr if best else None, "seconds": time.perf_counter() - began}
    note(spark, output, run, "COMPLETE", "")
    return summary


class UnfinishedRunError(ValueError):
    """What was written is not what the run should have written."""


def check_written(spark: SparkSession, staged: str, data: DataFrame, run: Run) -> None:
    """Read staged results again: one row per round, and for each split as many predictions and positives as the examples have."""
    rounds = spark.read.option("header", True).csv(f"{staged}/round_metrics").agg(F.count(F.lit(1)), F.count_distinct("round")).first()
    if tuple(rounds) != (run.rounds, run.rounds):
        raise UnfinishedRunError(f"{run.experiment_id}: {rounds[0]} rounds were written, not {run.rounds}")
    count = lambda rows: {r.split: (r.n, r.positives) for r in rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("positives")).collect()}
    written, wanted = count(spark.read.parquet(f"{staged}/predictions")), count(data)
    if written != wanted:
        raise UnfinishedRunError(f"{run.experiment_id}: predictions by split are {written}, not {wanted}")


def described(error: Exception) -> str:
    """Kind, text and the last calls of an error, for a status row."""
    return f"{type(error).__name__}: {str(error)[:500]}\n" + "".join(traceback.format_tb(error.__traceback__)[-4:])[-1500:]


def note(spark: SparkSession, output: str, run: Run, status: str, detail: str) -> None:
    row = (run.experiment_id, run.training.seed, status, detail, datetime.now(UTC).timestamp())
    sinks.write_status(spark.createDataFrame([row], "experiment_id string, seed int, status string, detail string, at double"), f"{output}/status")


def write_ledger(spark: SparkSession, run: Run, metrics: list[dict], path: str, *, clients: int, samples: int, groups: DataFrame) -> None:
    """One chained record per round. Times are nominal, two milliseconds apart, as records must not depend on the clock."""
    members = sorted((r.client, r.subcluster_id) for r in groups.collect())
    digest, head = canonical_sha256(members), f"MC{run.cluster_id}_HEAD"
    start, rows = datetime(2026, 1, 1, tzinfo=UTC), []
    links = ledger.chain([{"round": m["round"], "metrics": {k: float(v) for k, v in m.items() if k != "round" and v is not None}} for m in metrics], experiment=run.experiment_id, cluster=run.cluster_id, digest=digest)
    for i, link in enumerate(links):
        times = [(start + timedelta(milliseconds=2 * i + j)).isoformat() for j in (0, 1)]
        rows.append((link["round_id"], run.cluster_id, head, f"C{run.cluster_id}_R{link['round_id']:03d}", link["previous_main_model_hash"], link["new_main_model_hash"], "ward" if run.hierarchical else "none", canonical_sha256({"hierarchical": run.hierarchical, "groups": digest}), len({g for _, g in members}) if run.hierarchical else 1, digest, run.training.method, "weighted_mean", int(samples), int(clients), *times, head))
    records = spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t in ledger.FIELDS.items()))
    ledger.append(records, path, role=ledger.HEAD_ROLE, identity=head)


def run_seeds(data: DataFrame, runs: list[Run], seeds: list[int], output: str) -> DataFrame:
    """Every run with every seed; a failed one is noted and the others go on. The status of each experiment."""
    spark = data.sparkSession
    for run in runs:
        for seed in dict.fromkeys(seeds):
            seeded = replace(run, training=replace(run.training, seed=seed))
            try:
                run_experiment(data, seeded, output)
            except Exception as error:  # noqa: BLE001 - a run must not end the batch
                note(spark, output, seeded, "FAILED", described(error))
    states = sinks.read_status(spark, f"{output}/status").select("experiment_id", "seed", F.col("status").alias("state"))
    return reports.experiment_status(states)


def compare(rounds: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Treatment less control at the best rounds of each (control, treatment)."""
    best = scoring.best_round(rounds).select("experiment_id", "val_f1", "test_f1")
    return reports.deltas(best, rounds.sparkSession.createDataFrame(pairs, "control_id string, treatment_id string"), ["val_f1", "test_f1"])


def tune(data_of, base: Run, axes: dict[str, list], output: str, *, start: int = 0, most: int | None = None, preferred=None) -> DataFrame:
    """Run the open trials of a grid and give the best one.

    ``data_of(values)`` gives a trial's examples and ``axes`` may name fields of ``Training``.
    Results are appended trial by trial, so a search can be taken up again.
    """
    spark = SparkSession.getActiveSession()
    schema = "trial_id string, trial_no int, status string, val_f1 double, test_f1 double, test_fpr double, seconds double, detail string"
    path = f"{output}/trials"
    grid = reports.trial_grid(spark, axes, preferred)
    try:
        done = spark.read.schema(schema).parquet(path)
    except Exception as error:  # noqa: BLE001 - the first call finds no table
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = spark.createDataFrame([], schema)
    for trial in reports.open_trials(grid, done, start=start, most=most).orderBy("trial_no").collect():
        values = {a: trial[a] for a in axes}
        fields = {k: v for k, v in values.items() if k in federated.Training.__dataclass_fields__}
        run = replace(base, experiment_id=trial.trial_id, training=replace(base.training, **fields))
        try:
            s = run_experiment(data_of(values), run, output)
            row = (trial.trial_id, trial.trial_no, "COMPLETE", s["val_f1"], s["test_f1"], s["test_fpr"], s["seconds"], "")
        except Exception as error:  # noqa: BLE001 - a trial must not end the search
            row = (trial.trial_id, trial.trial_no, "FAILED", None, None, None, None, described(error))
        spark.createDataFrame([row], schema).write.mode("append").parquet(path)
    return reports.best_trial(spark.read.schema(schema).parquet(path))


def named_groups(groups: DataFrame, cluster: int) -> DataFrame:
    """(client_id, subcluster_id) of (client, subcluster_id), as memberships are saved."""
    return groups.select(client_name(F.lit(cluster), F.col("client") + 1).alias("client_id"), "subcluster_id")

