"""Runs by configuration and the commands, on a small series."""

import json

import pytest

from plumbline.__main__ import main
from plumbline.operators import grouping
from plumbline.plans import runs
from plumbline.sources.contract import ContractError, load_contract
from plumbline.sources.files import expanded, first_bytes, is_there, read_text, write_text

ENTRY = {"experiment_id": "A_C2", "cluster_id": 2, "model_family": "cnn1d", "fl_method": "FedAvg", "hierarchy": "flat", "seeds": [7, 8], "rounds": 3, "batch": 16, "groups": 2, "group_ids": ["H1", "H2"]}
CONTRACT = "cluster: 2\nname: s\ndirectory: {0}/data\nlabel: attack\norder: [time]\nexcluded: [attack, time]\nclients: 3\n"


def setup(tmp_path, entries):
    lines = ["time,sensor_a,sensor_b,mode,attack"] + [f"{i},{10 + i},{20 + i % 7},{'AB'[i % 2]},{int(i % 10 in (2, 6))}" for i in range(120)]
    (tmp_path / "data").mkdir()
    (tmp_path / "data/s.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "c.yaml").write_text(CONTRACT.format(tmp_path))
    (tmp_path / "e.yaml").write_text(json.dumps({"experiments": entries}))  # JSON is YAML
    return ["--output", str(tmp_path / "out"), "--contract", str(tmp_path / "c.yaml"), "--config", str(tmp_path / "e.yaml")]


def test_entries():
    assert runs.checked_entry(ENTRY) == ENTRY
    proposed = {**ENTRY, "experiment_id": "P_C2", "model_family": "compact_mlp", "fl_method": "FedProx", "hierarchy": "hierarchical_fixed"}
    assert runs.checked_entry(proposed)
    for change in ({"fl_method": "FedBN"}, {"mu": -1}, {"weight_scale": 0}, {"channels": [1, 2]}, {"aggregation": "median"}, {"model_family": "tcn"}, {"hierarchy": "flat"}):
        with pytest.raises(ContractError):
            runs.checked_entry(proposed | change)
    for bad in ("X_C1", "A"):
        with pytest.raises(ContractError):
            runs.checked_entry({**ENTRY, "experiment_id": bad})
    assert runs.settings(ENTRY)["seed"] == 7 and runs.settings(ENTRY)["rounds"] == 3
    assert runs.settings(ENTRY, smoke=True, seed=5) == {"rounds": 2, "epochs": 1, "batch": 16, "rate": 0.05, "cap": 256, "seed": 5}
    assert runs.common_settings([ENTRY, {**ENTRY, "rate": 0.1}])["batch"] == 16
    with pytest.raises(ContractError):
        runs.common_settings([ENTRY, {**ENTRY, "batch": 8}])
    assert runs.adapter({**ENTRY, "cluster_id": 1, "window": {"width": 4, "stride": 2}}).stride == 2
    for bad in ({"cluster_id": 1}, {"window": {"width": 4, "stride": 2}}):
        with pytest.raises(ContractError):
            runs.adapter(ENTRY | bad)
    with pytest.raises(ContractError):
        runs.clustering({**ENTRY, "groups": 3})


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbfx\n")
    (tmp_path / "b.txt").write_text("t")
    assert first_bytes(str(tmp_path / "a.csv"), 3) == b"\xef\xbb\xbf" and first_bytes(str(tmp_path / "b.txt"), 3) == b"t"
    assert [p.split("/")[-1] for p in expanded([str(tmp_path), str(tmp_path / "b.txt")])] == ["a.csv", "b.txt"]
    write_text(str(tmp_path / "new/x.txt"), "ä")
    assert is_there(str(tmp_path / "new")) and read_text(str(tmp_path / "new/x.txt")) == "ä" and not is_there(str(tmp_path / "none"))


def test_commands(spark, tmp_path, capsys):
    hierarchical = {**ENTRY, "experiment_id": "B_C2", "hierarchy": "hierarchical_fixed", "seeds": [7]}
    options = setup(tmp_path, [ENTRY, hierarchical, {**ENTRY, "experiment_id": "A_C9", "cluster_id": 9}])
    out = str(tmp_path / "out")
    main(["cluster", *options, "--experiment", "B_C2"], spark)
    before = read_text(f"{out}/memberships/cluster2.json")
    main(["run", *options, "--experiment", "B_C2", "--experiment", "A_C9", "--smoke", "--seed", "7"], spark)
    printed = capsys.readouterr().out
    assert printed.count("COMPLETE") == 1 and "FAILED" in printed and read_text(f"{out}/memberships/cluster2.json") == before
    made = json.loads(read_text(f"{out}/B_C2/seed_7/manifest.json"))
    assert made["settings"]["rounds"] == 2 and made["bytes"] == 4 * made["parameters"] and not made["weights_saved"]
    assert "| B_C2 |" in read_text(f"{out}/reports/report.md") and runs.curves(spark, out, "B_C2").where("seed = 7").count() == 2
    assert runs.confusion_summary(spark, out).where("split = 'test' AND experiment_id = 'B_C2' AND seed = '7'").count() == 1
    main(["figures", *options, "--experiment", "B_C2", "--seed", "7", "--seed", "9"], spark)
    printed = capsys.readouterr().out
    assert "B_C2" in printed and "|9 " in printed and "|7 " not in printed
    table = lambda name: spark.read.option("header", True).csv(f"{out}/reports/{name}")
    assert table("bands").where("experiment_id = 'B_C2' AND n = '1'").count() == 2 * len(runs.FIGURE_METRICS)
    assert {r.split for r in table("confusion").collect()} == {"train", "validation", "test"} and not is_there(f"{out}/reports/pairs")
    report = read_text(f"{out}/reports/report.md")
    assert "* A_C9, seed 7: FAILED" in report and "B_C2, seed" not in report
    assert {(r.experiment_id, r.state) for r in table("seeds").collect()} == {("A_C9", "FAILED"), ("B_C2", "COMPLETE")}
    columns = spark.read.option("header", True).csv(f"{out}/B_C2/seed_7/round_metrics").columns
    assert set(columns) >= {"validation_auroc", "test_pr_auc_default_threshold", "communication_cost_bytes", "threshold_used"}
    groups = runs.frozen_groups(spark, f"{out}/memberships/cluster2.json", hierarchical, lambda: pytest.fail("made anew"))
    assert groups.count() == 3
    with pytest.raises(grouping.MembershipError):
        runs.frozen_groups(spark, f"{out}/memberships/cluster2.json", {**hierarchical, "groups": 3, "group_ids": ["a", "b", "c"]}, None)


def test_tune_command(spark, tmp_path):
    """A search writes its configurations, results and a comparison with the runs that it names."""
    control = {**ENTRY, "experiment_id": "B_C2", "hierarchy": "hierarchical_fixed"}
    options = setup(tmp_path, [control])
    out = str(tmp_path / "out")
    main(["run", *options, "--experiment", "B_C2", "--smoke", "--seed", "7"], spark)
    main(["tune", *options, "--experiment", "B_C2", "--smoke", "--axis", "rate=0.01,0.05", "--most", "1", "--reference", "B_C2"], spark)
    found = json.loads(read_text(f"{out}/tuning/best_config.json"))
    assert found["best"]["trial_id"] == "trial_0001" and found["n_trials"] == 2 and found["n_complete"] == 1 and not found["fair"] and found["beats"].keys() == {"B_C2"}
    assert runs.load_trial(spark, f"{out}/tuning/configurations", "trial_0002")["rate"] == 0.05
    with pytest.raises(ContractError):
        runs.load_trial(spark, f"{out}/tuning/configurations", "trial_0003")
    states = runs.run_states(spark, [{**control, "seeds": [7, 8]}], spark.createDataFrame([("B_C2", 7, "COMPLETE")], "experiment_id string, seed int, state string"))
    assert sorted((r.seed, r.state) for r in states.collect()) == [(7, "COMPLETE"), (8, "MISSING")]


def test_staged_results_are_checked(spark, tmp_path):
    """Results that lack rows are refused before they take the place of others."""
    from plumbline.plans import experiments as E
    from plumbline.sources import sinks

    data = spark.createDataFrame([(c, s, c % 2) for c in range(6) for s in ("train", "test")], "client long, split string, label int")
    run = E.Run("A_C1", 1, None, 2)
    scores = data.selectExpr("'A_C1' AS experiment_id", "7 AS seed", "split", "client", "0.5D AS p", "label")
    sinks.write_csv(spark.createDataFrame([(1,), (2,)], "round int"), f"{tmp_path}/round_metrics")
    sinks.write_predictions(scores, f"{tmp_path}/predictions")
    E.check_written(spark, str(tmp_path), data, run)
    sinks.write_predictions(scores.where("client > 0 OR split = 'train'"), f"{tmp_path}/predictions")
    with pytest.raises(E.UnfinishedRunError, match="predictions by split"):
        E.check_written(spark, str(tmp_path), data, run)
    sinks.write_csv(spark.createDataFrame([(1,), (1,)], "round int"), f"{tmp_path}/round_metrics")
    with pytest.raises(E.UnfinishedRunError, match="rounds"):
        E.check_written(spark, str(tmp_path), data, run)


def test_data_commands(spark, tmp_path, capsys):
    options = setup(tmp_path, [ENTRY])[:4]
    main(["profile", *options, str(tmp_path / "data")], spark)
    main(["preprocess", *options], spark)
    main(["partition", *options], spark)
    printed = capsys.readouterr().out
    assert "[]" in printed and "ok" in printed and printed.count("C2_L00") == 3
    assert json.loads(read_text(f"{tmp_path}/out/summary.json"))["labels"] == {"0": 96, "1": 24}
    blocked = load_contract(str(tmp_path / "c.yaml")).__class__(2, "s", str(tmp_path / "data"), "none", excluded=("none",))
    assert runs.preprocess(spark, blocked, f"{tmp_path}/blocked", continue_on_blocked=True)["status"] == "blocked"
    with pytest.raises(ContractError):
        runs.preprocess(spark, blocked, f"{tmp_path}/blocked")


def test_comparisons(spark, tmp_path):
    results = spark.createDataFrame([("trial_0001", 1, "COMPLETE", 0.5, 0.6, 0.1, 1.0), ("trial_0002", 2, "FAILED", None, None, None, None)], "trial_id string, trial_no int, status string, val_f1 double, test_f1 double, test_fpr double, seconds double")
    references = spark.createDataFrame([("A_C1", 0.4), ("P_C1", 0.7), ("B_C1", None)], "experiment_id string, test_f1 double")
    from plumbline.operators import reports

    grid = reports.trial_grid(spark, {"x": [1, 2, 3]})
    found = runs.tuning_report(spark, grid, results, references, str(tmp_path), fair=True)
    assert found["beats"] == {"A_C1": True, "P_C1": False, "B_C1": None} and (found["n_trials"], found["n_attempted"], found["n_complete"]) == (3, 2, 1)
    assert json.loads(read_text(f"{tmp_path}/best_config.json"))["best"]["trial_id"] == "trial_0001"
    assert [e["x"] for e in runs.trial_entries(grid, ENTRY, ["x"])] == [1, 2, 3]
    spec = references.selectExpr("experiment_id", "'cnn' AS family")
    assert sorted((r.side, r.family) for r in runs.figure_rows(references, spec, "A_C1", "P_C1").collect()) == [("control", "cnn"), ("treatment", "cnn")]


def test_shared_folder_is_named_on_clusters():
    from types import SimpleNamespace

    from plumbline.sources.files import shared_root

    for master, folder in (("yarn", None), ("local-cluster[3,2,1000]", None), ("yarn", "hdfs:///x/")):
        context = SimpleNamespace(master=master, getConf=lambda f=folder: {"spark.checkpoint.dir": f}, getCheckpointDir=lambda: None)
        if folder:
            assert shared_root(SimpleNamespace(sparkContext=context)) == "hdfs:///x"
        else:
            with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
                shared_root(SimpleNamespace(sparkContext=context))
