"""Runs by configuration: settings, contracts of entries, dispatch by id, frozen groups, reports over seeds, manifests and tuning comparisons."""

from __future__ import annotations

import json
import math
from dataclasses import replace
from functools import reduce

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.hashing import canonical_sha256
from plumbline.functions.scalars import retyped
from plumbline.operators import features, federated, grouping, reports, scoring, sharding
from plumbline.operators.networks import Network
from plumbline.plans import experiments as E
from plumbline.sources import sinks
from plumbline.sources.contract import Contract, ContractError
from plumbline.sources.csv_tables import inspect, training_table
from plumbline.sources.files import is_there, read_text, write_text

# What the entries of each kind of run must say.
FAMILIES = {"cnn1d": "cnn", "compact_mlp": "mlp", "tcn": "tcn"}
METHODS = {"FedAvg": "fedavg", "FedBN": "fedbn", "FedProx": "fedprox", "SCAFFOLD": "scaffold"}
HIERARCHIES = ("flat", "hierarchical_fixed")
BASE = {"A": {"model_family": "cnn1d", "fl_method": "FedAvg", "hierarchy": "flat"}, "B": {"model_family": "cnn1d", "fl_method": "FedAvg", "hierarchy": "hierarchical_fixed"}}
PROPOSED = {1: ("tcn", "FedBN"), 2: ("compact_mlp", "FedProx"), 3: ("cnn1d", "SCAFFOLD")}
#: Smoke settings: enough to see that a run goes through.
SMOKE = {"rounds": 2, "cap": 256}


def load_entries(path: str) -> list[dict]:
    """The experiments of a YAML file, each over the file's ``defaults``; ids must be there and differ."""
    text = yaml.safe_load(read_text(path))
    entries = [{**text.get("defaults", {}), **e} for e in text.get("experiments", [])]
    ids = [e.get("experiment_id") for e in entries]
    if not entries or None in ids or len(set(ids)) != len(ids):
        raise ContractError(f"{path}: experiments need ids that differ")
    return entries


def suite_of(experiment_id: str) -> str:
    """A, B, P or AB: what an id's first part asks for."""
    suite = experiment_id.split("_")[0]
    if suite not in ("A", "B", "P", "AB") or "_" not in experiment_id:
        raise ContractError(f"unsupported experiment {experiment_id}")
    return suite


def checked_entry(entry: dict) -> dict:
    """The entry, if it keeps the contract of its suite: family, method and hierarchy, aggregation, and numbers in their ranges."""
    suite, cluster = suite_of(entry["experiment_id"]), entry.get("cluster_id")
    wanted = dict(BASE.get(suite, {"hierarchy": "hierarchical_fixed"}))
    if suite == "P":
        if cluster not in PROPOSED:
            raise ContractError(f"{entry['experiment_id']}: no proposed run for cluster {cluster}")
        wanted["model_family"], wanted["fl_method"] = PROPOSED[cluster]
    wrong = [f"{k} must be {v}" for k, v in wanted.items() if entry.get(k) != v]
    wrong += [f"{k} is unknown: {entry.get(k)}" for k, known in (("model_family", FAMILIES), ("fl_method", METHODS), ("hierarchy", HIERARCHIES)) if entry.get(k) not in known]
    wrong += ["aggregation must be weighted_mean"] * (entry.get("aggregation", "weighted_mean") != "weighted_mean")
    wrong += ["mu must not be negative"] * (entry.get("mu", 0) < 0) + ["weight_scale must be positive"] * (entry.get("weight_scale", 1) <= 0)
    channels = entry.get("channels", [1, 1, 1])
    wrong += ["channels must be three positive whole numbers"] * (len(channels) != 3 or any(not isinstance(c, int) or isinstance(c, bool) or c < 1 for c in channels))
    if wrong:
        raise ContractError(f"{entry['experiment_id']}: {'; '.join(wrong)}")
    return entry


def settings(entry: dict, *, smoke: bool = False, **overrides) -> dict:
    """rounds, epochs, batch, rate, seed and cap of a run: what is given goes before smoke settings, and these before the entry's own.

    Without a seed the first of ``seeds`` counts.
    """
    if not entry.get("seeds") and entry.get("seed") is None and overrides.get("seed") is None:
        raise ContractError(f"{entry['experiment_id']}: seeds must name one at least")
    found = {"rounds": 50, "epochs": 1, "batch": 128, "rate": 0.05, "cap": None, "seed": entry.get("seeds", [None])[0]} | {k: entry[k] for k in ("rounds", "epochs", "batch", "rate", "cap", "seed") if entry.get(k) is not None}
    return found | (SMOKE if smoke else {}) | {k: v for k, v in overrides.items() if v is not None}


def common_settings(entries: list[dict], **options) -> dict:
    """The one setting that all entries of an ablation share in all but the rate; an error if they don't."""
    found = [{k: v for k, v in settings(e, **options).items() if k != "rate"} for e in entries]
    if any(f != found[0] for f in found):
        raise ContractError("the runs of an ablation must share their settings")
    return found[0]


def adapter(entry: dict) -> E.Window | None:
    """Windows for the first cluster, which must name them; single rows of one channel for the others, which must not."""
    window = entry.get("window")
    if entry["cluster_id"] == 1:
        if not window or window["width"] < 1 or window["stride"] < 1:
            raise ContractError(f"{entry['experiment_id']}: cluster 1 needs a window of positive width and stride")
        return E.Window(window["width"], window["stride"])
    if window:
        raise ContractError(f"{entry['experiment_id']}: cluster {entry['cluster_id']} takes single rows")
    return None


def clustering(entry: dict) -> tuple[int, list[str]]:
    """Number of groups and their fixed ids, which must agree."""
    k, ids = entry.get("groups"), entry.get("group_ids") or []
    if not isinstance(k, int) or isinstance(k, bool) or k < 1 or len(ids) != k or len(set(ids)) != k:
        raise ContractError(f"{entry['experiment_id']}: groups and group_ids must agree")
    return k, ids


def frozen_groups(spark: SparkSession, path: str, entry: dict, make, *, force: bool = False) -> DataFrame:
    """(client_id, subcluster_id) of the membership at ``path``: as it is if it is there, else made by ``make`` and saved."""
    k, ids = clustering(entry)
    if force or not is_there(path):
        members = sorted((r.client_id, r.subcluster_id) for r in make().collect())
        write_text(path, json.dumps(grouping.membership_record(members, cluster=entry["cluster_id"], dataset=entry.get("dataset", ""), group_ids=ids, reuse=["B", "P"])))
    return grouping.read_membership(spark, path, cluster=entry["cluster_id"], groups=k)


def run_entry(spark: SparkSession, contract: Contract, entry: dict, output: str, *, smoke: bool = False, **overrides) -> dict:
    """Dispatch one entry: its examples by the cluster's adapter, its groups (frozen for all but flat runs), its trainer; then the summary and the manifest."""
    checked_entry(entry)
    window, chosen = adapter(entry), settings(entry, smoke=smoke, **overrides)
    shards, names = E.sharded_features(spark, contract)
    data = E.examples(shards, window, chosen["cap"])
    flat, membership = entry["hierarchy"] == "flat", f"{output}/memberships/cluster{entry['cluster_id']}.json"
    if flat:
        data = data.withColumn("subcluster_id", F.lit("all"))
    else:
        groups = frozen_groups(spark, membership, entry, lambda: E.named_groups(E.form_groups(shards, names, *clustering(entry)), entry["cluster_id"]))
        groups = groups.select((F.substring_index("client_id", "L", -1).cast("long") - 1).alias("client"), "subcluster_id")
        data = data.join(groups, "client")
    network = Network(FAMILIES[entry["model_family"]], len(names), window.width if window else 1, **({"blocks": tuple(entry["channels"])} if "channels" in entry else {}))
    training = federated.Training(network, method=METHODS[entry["fl_method"]], rate=chosen["rate"], batch=chosen["batch"], epochs=chosen["epochs"], adam=network.kind == "mlp", mu=entry.get("mu", 0.01), seed=chosen["seed"])
    run = E.Run(entry["experiment_id"], entry["cluster_id"], training, chosen["rounds"], hierarchical=not flat)
    before = None if flat else read_text(membership)
    summary = E.run_experiment(data, run, output)
    if not flat and read_text(membership) != before:
        raise grouping.MembershipError("the membership changed during the run")
    finalise(spark, run, summary, output)
    return summary


def finalise(spark: SparkSession, run: E.Run, summary: dict, output: str) -> None:
    """Write a run's summary as one CSV row, the threshold of its best round, and its manifest, from its metrics as they were written."""
    base = f"{output}/{run.experiment_id}/seed_{run.training.seed}"
    rounds = spark.read.option("header", True).csv(f"{base}/round_metrics")
    if rounds.count() != run.rounds:
        raise ContractError(f"{base}: {rounds.count()} rounds were written, not {run.rounds}")
    best = rounds.where(F.col("round").cast("int") == summary["best_round"]).select(retyped("threshold").alias("threshold")).first()
    sinks.write_csv(spark.createDataFrame([{**summary, "threshold": best.threshold if best else None}], "experiment_id string, seed int, best_round int, val_f1 double, test_f1 double, test_fpr double, seconds double, threshold double"), f"{base}/summary")
    write_text(f"{base}/manifest.json", json.dumps(manifest(run, summary), sort_keys=True, indent=1))


def manifest(run: E.Run, summary: dict) -> dict:
    """What a run trained, without weights: shapes of the state, its size, settings and their digest."""
    shapes = {k: list(s) for k, s in run.training.network.shapes().items()}
    count = sum(math.prod(s) for s in shapes.values())
    chosen = {f: getattr(run.training, f) for f in ("method", "rate", "batch", "epochs", "adam", "mu", "seed")} | {"rounds": run.rounds, "hierarchical": run.hierarchical, "family": run.training.network.kind}
    return {"experiment_id": run.experiment_id, "cluster_id": run.cluster_id, "best_round": summary["best_round"], "parameters": count, "bytes": 4 * count, "shapes": shapes, "settings": chosen, "settings_hash": canonical_sha256(chosen), "weights_saved": False}


def preprocess(spark: SparkSession, contract: Contract, output: str, *, continue_on_blocked: bool = False) -> dict:
    """Fit on all rows and write the typed rows, the fit and the label counts; a broken contract ends it, or gives a summary that says blocked."""
    try:
        rows, numeric, text = training_table(spark, contract)
    except ContractError as error:
        if not continue_on_blocked:
            raise
        found = {"status": "blocked", "reason": str(error), "code": error.code}
    else:
        keys = sharding.usable_order_columns(rows, list(contract.order))
        rows = (sharding.order_keys(rows, keys) if keys else rows).withColumn("pos", F.monotonically_increasing_id())
        fit, (categories, dropped) = features.fit_numeric(rows, numeric), features.fit_categories(rows, text)
        sinks.write_table(features.transform(rows, fit, categories), f"{output}/rows")
        labels = {str(r.label): r["count"] for r in rows.groupBy("label").count().collect()}
        found = {"status": "ok", "features": features.feature_names(fit, categories), "numeric": {k: list(v) for k, v in fit.kept.items()}, "categories": categories, "dropped": fit.dropped | dropped, "labels": labels}
    write_text(f"{output}/summary.json", json.dumps(found, sort_keys=True, indent=1))
    return found


# --- over runs -------------------------------------------------------------------------------


def curves(spark: SparkSession, output: str, experiment_id: str) -> DataFrame:
    """The round metrics of all seeds of an experiment with the seed that its folder names."""
    rows = spark.read.option("header", True).csv(f"{output}/{experiment_id}/seed_*/round_metrics")
    return rows.withColumn("seed", F.regexp_extract(F.input_file_name(), r"/seed_(\d+)/", 1).cast("int"))


def missing_inputs(required: DataFrame, available: DataFrame) -> DataFrame:
    """The (experiment_id, seed) that a batch of figures needs and that have no artefacts."""
    return required.select("experiment_id", "seed").distinct().join(available.select("experiment_id", "seed").distinct(), ["experiment_id", "seed"], "left_anti")


def figure_rows(metrics: DataFrame, spec: DataFrame, control_id: str, treatment_id: str) -> DataFrame:
    """The control's and the treatment's rows of one figure with what the matrix says about them."""
    sides = [metrics.where(F.col("experiment_id") == i).withColumn("side", F.lit(side)) for i, side in ((control_id, "control"), (treatment_id, "treatment"))]
    return sides[0].union(sides[1]).join(spec, "experiment_id")


FIGURE_METRICS = ("train_loss", "val_f1", "test_f1", "test_fpr", "test_auroc")


def figure_tables(spark: SparkSession, entries: list[dict], available: DataFrame, output: str) -> None:
    """What the figures of experiments show, as CSV under ``reports``, for those that have artefacts.

    ``bands``: mean and deviation over seeds by round of each metric; ``unaligned``: experiments
    whose seeds have different rounds; ``confusion``: rates by split; ``pairs``: rows of controls
    and treatments side by side.
    """
    ids = sorted({e["experiment_id"] for e in entries} & {r.experiment_id for r in available.select("experiment_id").distinct().collect()})
    if not ids:
        return
    rows = curves(spark, output, "{" + ",".join(ids) + "}")
    numbers = rows.select("experiment_id", "seed", F.col("round").cast("int").alias("round"), *(rows[m].try_cast("double").alias(m) for m in FIGURE_METRICS))
    bands = [reports.curve_band(numbers, m).select("experiment_id", F.lit(m).alias("metric"), "round", "n", "mean", "std") for m in FIGURE_METRICS]
    sinks.write_csv(reduce(DataFrame.union, bands).orderBy("experiment_id", "metric", "round"), f"{output}/reports/bands")
    uneven = reports.unaligned_rounds(numbers).orderBy("experiment_id")
    if uneven.limit(1).collect():
        sinks.write_csv(uneven, f"{output}/reports/unaligned")
    sinks.write_csv(confusion_summary(spark, output).where(F.col("experiment_id").isin(ids)).orderBy("experiment_id", "seed", "split"), f"{output}/reports/confusion")
    spec = spark.createDataFrame([(e["experiment_id"], e.get("cluster_id"), e.get("fl_method")) for e in entries if e["experiment_id"] in ids], "experiment_id string, cluster_id int, fl_method string")
    best = scoring.best_round(numbers, by=("experiment_id", "seed"))
    pairs = [figure_rows(best, spec, e["control"], e["experiment_id"]).withColumn("pair", F.lit(f"{e['control']}:{e['experiment_id']}")) for e in entries if e["experiment_id"] in ids and e.get("control") in ids]
    if pairs:
        sinks.write_csv(reduce(DataFrame.unionByName, pairs).orderBy("pair", "side", "seed"), f"{output}/reports/pairs")


def run_states(spark: SparkSession, entries: list[dict], status: DataFrame, seeds=None) -> DataFrame:
    """(experiment_id, seed, state) of every seed that the entries ask for; MISSING if it has no status."""
    wanted = [(e["experiment_id"], int(s)) for e in entries for s in dict.fromkeys(seeds or e.get("seeds") or [e.get("seed", 42)])]
    grid = spark.createDataFrame(wanted, "experiment_id string, seed int").distinct()
    return grid.join(status, ["experiment_id", "seed"], "left").select("experiment_id", "seed", F.coalesce("state", F.lit("MISSING")).alias("state"))


def seed_report(spark: SparkSession, summaries: DataFrame, metrics: list[str], output: str, *, title: str = "Results over seeds", states: DataFrame | None = None) -> DataFrame:
    """Mean and deviation over seeds by experiment: as CSV, as a table of display texts, and as Markdown, sorted by experiment.

    With ``states`` (experiment_id, seed, state) the report also lists the seeds that have no
    complete result, and has a CSV of the state of every seed.
    """
    long = reports.mean_std(summaries, metrics)
    sinks.write_csv(long.select("experiment_id", "metric", "n", "mean", "std").orderBy("experiment_id", "metric"), f"{output}/mean_std")
    display = long.groupBy("experiment_id").pivot("metric", metrics).agg(F.first("display")).orderBy("experiment_id")
    sinks.write_csv(display, f"{output}/display")
    rows = display.collect()  # a row per experiment
    lines = [f"# {title}", "", "| experiment | " + " | ".join(metrics) + " |", "| --- " * (len(metrics) + 1) + "|", *("| " + " | ".join([r.experiment_id, *(r[m] for m in metrics)]) + " |" for r in rows)]
    if states is not None:
        sinks.write_csv(states.orderBy("experiment_id", "seed"), f"{output}/seeds")
        without = states.where("state <> 'COMPLETE'").orderBy("experiment_id", "seed").collect()
        lines += ["", "## Seeds without a result", "", *(f"* {r.experiment_id}, seed {r.seed}: {r.state}" for r in without)] if without else ["", "All seeds have results."]
    write_text(f"{output}/report.md", "\n".join(lines) + "\n")
    return display


def write_trials(spark: SparkSession, entries: list[dict], path: str) -> None:
    """One JSON line per trial with its whole configuration, as ``load_trial`` reads it."""
    rows = spark.createDataFrame([(e["trial_id"], json.dumps(e, sort_keys=True)) for e in entries], "trial_id string, configuration string")
    sinks.write_json(rows.orderBy("trial_id"), path)


def load_trial(spark: SparkSession, path: str, trial_id: str) -> dict:
    """The configuration of one trial."""
    found = spark.read.schema("trial_id string, configuration string").json(path).where(F.col("trial_id") == trial_id).first()
    if not found:
        raise ContractError(f"{path} has no trial {trial_id}")
    return json.loads(found.configuration)


def beats_references(best: DataFrame, references: DataFrame, metric: str = "test_f1") -> DataFrame:
    """The best trial beside each reference run: reference_id, reference, trial, beats; null where one has no number."""
    trial = F.broadcast(best.select("trial_id", F.col(metric).alias("trial")))  # one row
    return references.select(F.col("experiment_id").alias("reference_id"), F.col(metric).alias("reference")).crossJoin(trial).withColumn("beats", F.col("trial") > F.col("reference"))


def tuning_report(spark: SparkSession, grid: DataFrame, results: DataFrame, references: DataFrame, output: str, *, fair: bool) -> dict:
    """Counts of trials, the best one and whether it beats each reference, as JSON and Markdown. ``fair`` says that trials ran at full length without caps."""
    counts, best = reports.trial_counts(grid, results).first().asDict(), reports.best_trial(results)
    beaten = {r.reference_id: r.beats for r in beats_references(best, references).collect()}
    top = best.first()
    found = {"fair": fair, **counts, "best": top.asDict() if top else None, "beats": beaten}
    write_text(f"{output}/best_config.json", json.dumps(found, sort_keys=True, indent=1, default=str))
    write_text(f"{output}/tuning.md", "\n".join(["# Tuning", "", *(f"* {k}: {v}" for k, v in found.items())]) + "\n")
    return found


def trial_entries(grid: DataFrame, base: dict, axes: list[str]) -> list[dict]:
    """An entry for each trial of a grid: the base with the trial's values. For the grids of a search, a few thousand rows."""
    return [{**base, "trial_id": r.trial_id, **{a: r[a] for a in axes}} for r in grid.orderBy("trial_no").collect()]


def run_suite(spark: SparkSession, contracts: dict[int, Contract], entries: list[dict], output: str, *, smoke: bool = False, seeds=None) -> DataFrame:
    """Every entry with every seed; a failed one is noted and the others go on. The status of each experiment, and the report over seeds."""
    for entry in entries:
        for seed in dict.fromkeys(seeds or entry.get("seeds") or [entry.get("seed", 42)]):
            try:
                run_entry(spark, contracts[entry["cluster_id"]], entry, output, smoke=smoke, seed=seed)
            except Exception as error:  # noqa: BLE001 - a run must not end the suite
                E.note(spark, output, E.Run(entry["experiment_id"], entry.get("cluster_id", 0), replace(federated.Training(Network("mlp", 1)), seed=seed), 0), "FAILED", E.described(error))
    status = sinks.read_status(spark, f"{output}/status").select("experiment_id", "seed", F.col("status").alias("state"))
    if status.where("state = 'COMPLETE'").limit(1).collect():
        summaries = spark.read.option("header", True).csv(f"{output}/*/seed_*/summary")
        seed_report(spark, summaries, ["val_f1", "test_f1", "test_fpr", "seconds"], f"{output}/reports", states=run_states(spark, entries, status, seeds))
    return reports.experiment_status(status)


def confusion_summary(spark: SparkSession, output: str, threshold: float = 0.5) -> DataFrame:
    """Rates of each experiment, seed and split at one threshold, from the predictions as they were written."""
    # runs lie under different roots, so what their folders say is taken from the paths
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{output}/*/seed_*/predictions").withColumn("p", F.col("probability").cast("double"))
    rows = rows.withColumns({c: F.regexp_extract("_metadata.file_path", f"/{c}=([^/]*)/", 1) for c in ("experiment_id", "seed", "split")})
    return scoring.rates(scoring.confusion(rows, threshold, by=("experiment_id", "seed", "split")))


def profile_json(spark: SparkSession, contract: Contract, paths: list[str], output: str) -> dict:
    """The inspection of files as JSON, with an audit note in Markdown."""
    found = inspect(spark, paths, contract, consistent=False, require_label=False)
    found["profile"] = [r.asDict() for r in found["profile"]]
    write_text(f"{output}/profile.json", json.dumps(found, sort_keys=True, indent=1))
    notes = [*found["blockers"], *found["issues"]] or ["nothing blocks training"]
    write_text(f"{output}/audit.md", "\n".join([f"# {contract.name}", "", *(f"* {n}" for n in notes)]) + "\n")
    return found
