"""Commands: ``python -m plumbline COMMAND``. Contracts and experiments are YAML files; results go under ``--output``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession, functions as F

from plumbline.operators import sharding
from plumbline.plans import experiments as E, runs
from plumbline.sources import experiments as matrices, harmonise, sinks
from plumbline.sources.contract import load_contract, training_files
from plumbline.sources.csv_tables import scan
from plumbline.sources.files import expanded


def _contracts(paths):
    return {c.cluster: c for c in map(load_contract, paths)}


def _chosen(args):
    entries = runs.load_entries(args.config)
    known = [e["experiment_id"] for e in entries]
    wanted = matrices.select_experiments(known, explicit=args.experiment or (), suite=args.suite, everything=args.all)
    return [e for w in wanted for e in entries if e["experiment_id"] == w]


def run(spark, args):
    """Run the chosen experiments."""
    return runs.run_suite(spark, _contracts(args.contract), _chosen(args), args.output, smoke=args.smoke, seeds=args.seed)


def ablation(spark, args):
    """Run an ablation, whose runs must share their settings, and compare treatment with control."""
    entries = _chosen(args)
    runs.common_settings(entries, smoke=args.smoke)
    status = runs.run_suite(spark, _contracts(args.contract), entries, args.output, smoke=args.smoke, seeds=args.seed)
    ids = [e["experiment_id"] for e in entries]
    rows = spark.read.option("header", True).csv(f"{args.output}/*/seed_*/round_metrics")
    numbers = rows.select("experiment_id", *(rows[c].try_cast("double").alias(c) for c in ("round", "val_f1", "test_f1", "test_fpr", "threshold")))
    pairs = [(e["control"], e["experiment_id"]) for e in entries if e.get("control") in ids]
    if pairs:
        sinks.write_csv(E.compare(numbers, pairs), f"{args.output}/reports/ablation")
    return status


def cluster(spark, args):
    """Form the groups of a cluster's shards, unless they are frozen already."""
    contract, entry = load_contract(args.contract[0]), _chosen(args)[0]
    shards, names = E.sharded_features(spark, contract)
    return runs.frozen_groups(spark, f"{args.output}/memberships/cluster{contract.cluster}.json", entry, lambda: E.named_groups(E.form_groups(shards, names, *runs.clustering(entry)), contract.cluster), force=args.force)


def combine(spark, args):
    """Put the contract's files together in one table of text."""
    contract = load_contract(args.contract[0])
    parts = {p.rstrip("/").split("/")[-1].removesuffix(".csv"): scan(spark, [p]).drop("file_ord", "row_ord") for p in training_files(contract)}
    sinks.write_table(harmonise.harmonised(parts, shared=list(contract.order), last=[contract.label]), f"{args.output}/combined")
    return spark.read.parquet(f"{args.output}/combined").groupBy("source").count()


def profile(spark, args):
    """Profile CSV files or folders of them."""
    print(json.dumps(runs.profile_json(spark, load_contract(args.contract[0]), expanded(args.path), args.output)["blockers"]))


def preprocess(spark, args):
    """Fit and transform all rows of a contract."""
    print(runs.preprocess(spark, load_contract(args.contract[0]), args.output, continue_on_blocked=args.continue_on_blocked)["status"])


def partition(spark, args):
    """Write the shards' metadata."""
    contract = load_contract(args.contract[0])
    shards, _ = E.sharded_features(spark, contract)
    sinks.write_json(sharding.client_metadata(shards, contract.cluster), f"{args.output}/clients/cluster{contract.cluster}")
    return spark.read.json(f"{args.output}/clients/cluster{contract.cluster}").select("client_id", "n_rows")


def tune(spark, args):
    """Search a grid from the first chosen experiment; values of ``--axis name=v1,v2`` are its axes."""
    entry, axes = _chosen(args)[0], {k: [float(x) if "." in x else int(x) for x in v.split(",")] for k, v in (a.split("=") for a in args.axis)}
    contract = _contracts(args.contract)[entry["cluster_id"]]
    chosen = runs.settings(entry, smoke=args.smoke)
    shards, names = E.sharded_features(spark, contract)
    data = E.examples(shards, runs.adapter(entry), chosen["cap"]).join(E.form_groups(shards, names, *runs.clustering(entry)), "client").cache()
    window = runs.adapter(entry)
    network = runs.Network(runs.FAMILIES[entry["model_family"]], len(names), window.width if window else 1)
    base = E.Run(entry["experiment_id"], entry["cluster_id"], runs.federated.Training(network, method=runs.METHODS[entry["fl_method"]], rate=chosen["rate"], batch=chosen["batch"], seed=chosen["seed"]), chosen["rounds"])
    folder = f"{args.output}/tuning"
    grid = runs.reports.trial_grid(spark, axes)
    runs.write_trials(spark, runs.trial_entries(grid, entry, list(axes)), f"{folder}/configurations")
    best = E.tune(lambda values: data, base, axes, folder, most=args.most)
    references = spark.createDataFrame([], "experiment_id string, test_f1 double")
    if args.reference:
        rows = spark.read.option("header", True).csv([f"{args.output}/{r}/seed_*/summary" for r in args.reference])
        references = rows.groupBy("experiment_id").agg(F.avg(rows["test_f1"].try_cast("double")).alias("test_f1"))
    # a search is fair if its trials ran as long, and on as many examples, as the runs that it is held against
    runs.tuning_report(spark, grid, spark.read.parquet(f"{folder}/trials"), references, folder, fair=not args.smoke and not chosen["cap"])
    return best


def figures(spark, args):
    """Say which chosen experiments lack artefacts, and write what the figures of the others show: bands, confusion, pairs."""
    have = matrices.artifact_listing(spark, args.output)
    wanted = spark.createDataFrame([(e["experiment_id"], s) for e in _chosen(args) for s in args.seed or e.get("seeds") or [42]], "experiment_id string, seed long")
    runs.figure_tables(spark, _chosen(args), have, args.output)
    return runs.missing_inputs(wanted, have)


COMMANDS = {"run": run, "ablation": ablation, "cluster": cluster, "combine": combine, "profile": profile, "preprocess": preprocess, "partition": partition, "tune": tune, "figures": figures}


def main(argv=None, spark: SparkSession | None = None):
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, function in COMMANDS.items():
        one = commands.add_parser(name, help=function.__doc__)
        one.add_argument("--output", required=True)
        one.add_argument("--contract", action="append", default=[])
        one.add_argument("--seed", type=int, action="append")
        one.add_argument("--smoke", action="store_true")
        if name in ("run", "ablation", "cluster", "tune", "figures"):
            one.add_argument("--config", required=True)
            one.add_argument("--experiment", action="append")
            one.add_argument("--suite")
            one.add_argument("--all", action="store_true")
        if name == "cluster":
            one.add_argument("--force", action="store_true")
        if name == "preprocess":
            one.add_argument("--continue-on-blocked", action="store_true")
        if name == "profile":
            one.add_argument("path", nargs="+")
        if name == "tune":
            one.add_argument("--axis", action="append", required=True)
            one.add_argument("--most", type=int)
            one.add_argument("--reference", action="append")
    args = parser.parse_args(argv)
    found = COMMANDS[args.command](spark or SparkSession.builder.appName("plumbline").getOrCreate(), args)
    if found is not None:
        found.show(100, truncate=False)


if __name__ == "__main__":
    main()
