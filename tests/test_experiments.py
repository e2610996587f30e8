"""A whole run on a small series: contract, shards, groups, training, tables, ledger, trials."""

from plumbline.operators import federated, ledger
from plumbline.operators.networks import Network
from plumbline.plans import experiments as E
from plumbline.sources import sinks
from plumbline.sources.contract import Contract


def series(tmp_path):
    lines = ["time,sensor_a,sensor_b,mode,attack"] + [f"{i},{10 + i},{20 + i % 7},{'AB'[i % 2]},{int(i % 10 in (2, 6))}" for i in range(120)]
    (tmp_path / "data").mkdir()
    (tmp_path / "data/s.csv").write_text("\n".join(lines) + "\n")
    return Contract(cluster=1, name="s", directory=str(tmp_path / "data"), label="attack", order=("time",), excluded=("attack", "time"), clients=3)


def test_run(spark, tmp_path):
    shards, names = E.sharded_features(spark, series(tmp_path))
    assert names == ["sensor_a", "sensor_b", "mode=A", "mode=B"]
    groups = E.form_groups(shards, names, 2, ["H1", "H2"])
    assert sorted(r.subcluster_id for r in groups.collect())[0] == "H1" and groups.count() == 3
    data = E.examples(shards, E.Window(4, 2)).join(groups, "client")
    assert data.where("client = 0 AND split = 'train'").count() == (28 - 4) // 2 + 1
    run = E.Run("P_C1", 1, federated.Training(Network("cnn", 4, 4), rate=0.05, batch=16), rounds=2)
    out = str(tmp_path / "out")
    summary = E.run_experiment(data, run, out)
    assert summary["best_round"] in (1, 2)
    assert spark.read.parquet(f"{out}/P_C1/seed_42/predictions").count() == data.count()
    records = ledger.read(spark, f"{out}/P_C1/ledger")
    assert records.count() == 2 and ledger.broken_links(records).count() == 0 and ledger.violations(records).count() == 0
    assert sinks.read_status(spark, f"{out}/status").first().status == "COMPLETE"
    rows = E.examples(shards, cap=5).join(groups, "client")
    assert rows.where("client = 1 AND split = 'train'").count() == 5
    broken = E.Run("B_C1", 1, federated.Training(Network("cnn", 9, 9)), rounds=1)
    status = {r.experiment_id: r.status for r in E.run_seeds(data, [broken], [1, 1], out).collect()}
    assert status == {"P_C1": "COMPLETE", "B_C1": "FAILED"}
    best = E.tune(lambda values: data, run, {"rate": [0.01, 0.05]}, str(tmp_path / "tuning"), most=1).first()
    assert best.trial_id == "trial_0001"
