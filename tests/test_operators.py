"""Operators on small tables with known results."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import hashing, scalars as S
from plumbline.operators import features, federated, grouping, ledger, networks, profile, reports, running, scoring, sharding, state


def values(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def test_cells(spark):
    rows = spark.createDataFrame([(c,) for c in ["", " NA ", "n/a", "NaN", "NULL", "none", "0", "-", "missing", None]], "c string")
    assert [r[0] for r in rows.select(S.is_missing("c")).collect()] == [True] * 6 + [False] * 3 + [True]
    good, bad = ["1", " 1 ", "+1", ".5", "1.", "1e5", "inf", "1_000"], ["1d", "1f", "1L", "0x10", "a", ""]
    rows = spark.createDataFrame([(c,) for c in good + bad], "c string")
    found = values(rows, S.to_number("c"))
    assert [x for (x,) in found] == [float(g.replace("_", "")) for g in good] + [None] * len(bad)


def test_labels(spark):
    raw = ["0", "0.0", "Normal", "benign", "1", "1.0", "ATTACK", "malicious", "anomaly", "2", "true", "suspicious", "false"]
    rows = spark.createDataFrame([(c,) for c in raw], "c string")
    assert [x for (x,) in values(rows, S.binary_label("c"))] == [0] * 4 + [1] * 5 + [None] * 4
    assert [x for (x,) in values(rows, S.profile_label("c"))] == [0, None, 0, 0, 1, None, 1, 1, 1, None, 1, None, 0]


def test_names_and_dates(spark):
    one = spark.range(1).select(S.client_name(F.lit(1), F.lit(1)), S.round_name(F.lit(1), F.lit(40)), S.day_key(F.lit("5-Apr-19")), S.client_number(F.lit("C1_L012")), S.source_name(F.lit("/x/Train_Test_IoT_GPS_Tracker.csv")), S.mean_std_text(F.lit(0.9), F.lit(0.08164)))
    assert tuple(one.first()) == ("C1_L001", "C1_R040", "2019-04-05", 12, "gps_tracker", "0.9000 +- 0.0816")


def test_order_shards_and_splits(spark):
    times, labels = [5, 1, 6, 2, 7, 3, 8, 4, 9, 10, 11, 12], [1, 0, 1, 0, 1, 0, 1, 0, 0, 1, 0, 1]
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(times, labels))], "row long, time int, label int")
    for buckets in (1, 4):
        ordered = running.positions(rows, ["time"], buckets=buckets).orderBy("pos")
        assert [r.row for r in ordered.collect()] == [1, 3, 5, 7, 0, 2, 4, 6, 8, 9, 10, 11]
    split = sharding.shard_and_split(rows, ["time"], 3, ratios=(0.5, 0.25, 0.25))
    counts = {(r.client, r.split): (r.n_rows, r.single_class) for r in sharding.split_counts(split).collect()}
    assert [counts[c, "train"][0] for c in range(3)] == [2, 2, 2]
    assert all(counts[0, s][1] for s in sharding.SPLITS)
    assert [r.start for r in sharding.client_metadata(split, 1).orderBy("client_id").collect()] == [0, 4, 8]
    ten = sharding.shards(spark.range(10).withColumnRenamed("id", "pos"), 10, 3)
    assert sorted(r["count"] for r in ten.groupBy("client").count().collect()) == [3, 3, 4]
    assert {r.client for r in ten.where("pos < 3").collect()} == {0} and {r.client for r in ten.where("pos >= 6").collect()} == {2}
    three = sharding.shards(spark.range(3).withColumnRenamed("id", "pos"), 3, 1).withColumn("split", sharding.split_of())
    assert [r.split for r in three.orderBy("pos").collect()] == ["train", "train", "test"]
    with pytest.raises(sharding.CoverageError):
        sharding.shard_and_split(rows, ["time"], 13)
    with pytest.raises(sharding.CoverageError):
        sharding.check_coverage(split.withColumn("label", F.lit(0)))


def test_positions_of_ties(spark):
    """Rows with one first key, nulls among the others, spread over buckets and keep their order."""
    rows = spark.createDataFrame([(5, i * 37 % 101 if i else None, i) for i in range(101)], "a int, b int, c int")
    found = [r.c for r in running.positions(rows, ["a", "b"], buckets=7).orderBy("pos").collect()]
    assert found == [0, *sorted(range(1, 101), key=lambda i: i * 37 % 101)]
    assert running._ranged(rows, ["a", "b"], ranges=7).select("__range").distinct().count() >= 5


def test_order_keys(spark):
    rows = spark.createDataFrame([("10", "5-Apr-19", "b"), ("9", "12-Mar-19", "a")], "n string, d string, t string")
    assert values(sharding.order_keys(rows, ["n", "d", "t"]), "key_n", "key_d", "key_t") == [(10.0, "2019-04-05", "b"), (9.0, "2019-03-12", "a")]
    assert sharding.usable_order_columns(rows.union(spark.createDataFrame([("", "x", "y")], rows.schema)), ["n", "d", "q"]) == ["d"]


def test_fit_and_transform(spark):
    rows = spark.createDataFrame([(0, 1.0, "A", None, 5.0), (1, None, "B", None, 5.0), (2, 3.0, "A", None, 5.0)], "pos long, sensor double, mode string, gone double, same double")
    fit = features.fit_numeric(rows, ["sensor", "gone", "same"])
    assert fit.dropped == {"gone": "all_missing", "same": "near_constant"}
    assert fit.kept["sensor"] == pytest.approx((2.0, 2.0, math.sqrt(2 / 3)))
    kept, dropped = features.fit_categories(rows, ["mode"])
    assert kept == {"mode": ["A", "B"]} and features.feature_names(fit, kept) == ["sensor", "mode=A", "mode=B"]
    new = spark.createDataFrame([(None, "C")], "sensor double, mode string")
    assert features.transform(new, fit, kept).first().features == [0.0, 0.0, 0.0]
    many = spark.createDataFrame([(f"c{i}", "x", f"d{i % 20}") for i in range(21)], "a string, b string, c string")
    kept, dropped = features.fit_categories(many, ["a", "b", "c"])
    assert dropped == {"a": "too_many_categories", "b": "single_category"} and len(kept["c"]) == 20


def test_windows(spark):
    rows = spark.createDataFrame([(0, "train", i, int(i == 5), [float(i)]) for i in range(10)], "client int, split string, local_pos int, label int, features array<double>")
    found = features.window_features(rows, width=4, stride=2).orderBy("start_pos").collect()
    assert [r.start_pos for r in found] == [0, 2, 4, 6] and [r.window_label for r in found] == [0, 1, 1, 0]
    assert found[1].window == [[2.0, 3.0, 4.0, 5.0]]
    assert features.window_labels(rows, width=11, stride=1).count() == 0 and features.too_short(rows, width=11).count() == 1
    assert features.capped(rows, 3).count() == 3
    assert features.class_weight(rows).first().positive_weight == 9.0


def test_scores(spark):
    scores = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "label int, p double")
    assert scoring.best_threshold(scores).first().threshold == 0.4
    assert scoring.ranking_metrics(scores).first().auroc == 0.75
    empty = scores.where("label = 0")
    assert scoring.best_threshold(empty).first().threshold == 0.5 and scoring.ranking_metrics(empty).first().auroc is None
    assert scoring.best_threshold(scores.limit(0)).first().threshold == 0.5
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 20, 400) / 20, rng.integers(0, 2, 400)
    rows = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label int, p double")
    pos, neg = p[y == 1], p[y == 0]
    area = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / len(pos) / len(neg)
    for buckets in (1, 5):
        assert scoring.ranking_metrics(rows, buckets=buckets).first().auroc == pytest.approx(area)


def test_means_and_merges(spark):
    long = lambda owner, n, arrays, sub=1: [(1, sub, owner, n, k, i, float(v)) for k, a in arrays.items() for i, v in enumerate(a)]
    schema = "cluster_id int, parent int, contributor int, n int, key string, idx int, value double"
    rows = spark.createDataFrame(long(1, 2, {"w": [1, 3], "b": [2]}) + long(2, 6, {"w": [5, 7], "b": [10]}), schema)
    state.check_updates(rows)
    assert {(r.key, r.idx): r.value for r in state.weighted_mean(rows).collect()} == {("w", 0): 4, ("w", 1): 6, ("b", 0): 8}
    rows = spark.createDataFrame(long(1, 1, {"conv.weight": [1, 2], "bn1.weight": [101]}) + long(2, 3, {"conv.weight": [5, 6], "bn1.weight": [301]}), schema)
    mean = state.weighted_mean(rows, batch_norm=False)
    assert sorted(values(mean, "key", "value")) == [("conv.weight", 4.0), ("conv.weight", 5.0)]
    reference = spark.createDataFrame([("conv.weight", 0, 0.0), ("conv.weight", 1, 0.0), ("bn1.weight", 0, 11.0)], "key string, idx int, value double")
    assert sorted(values(state.replace_state(reference, mean), "key", "value")) == [("bn1.weight", 11.0), ("conv.weight", 4.0), ("conv.weight", 5.0)]
    for broken in (rows.limit(0), rows.withColumn("cluster_id", F.col("contributor")), rows.withColumn("n", F.lit(0)), rows.where("NOT (contributor = 1 AND idx = 1)")):
        with pytest.raises(state.AggregationError):
            state.check_updates(broken)
    deltas = spark.createDataFrame([("conv_bias", 0, 1.0), ("conv_bias", 0, 3.0), ("dense_bias", 0, 2.0), ("dense_bias", 0, 6.0)], "key string, idx int, value double")
    zero = state.zero_state(deltas.select("key", "idx", "value").distinct().groupBy("key", "idx").agg(F.max("value").alias("value")))
    assert sorted(values(state.server_control(zero, deltas, 4), "key", "value")) == [("conv_bias", 1.0), ("dense_bias", 2.0)]
    one = spark.createDataFrame([("w", 0, 3.0), ("b", 0, 2.0)], "key string, idx int, value double")
    two = spark.createDataFrame([("w", 0, 1.0), ("b", 0, 1.0)], "key string, idx int, value double")
    assert state.proximal_penalty(one, two, 0.01).first().penalty == pytest.approx(0.025)


@pytest.mark.parametrize("network", [networks.Network("cnn", 2, 6), networks.Network("mlp", 5, hidden=(4, 3)), networks.Network("tcn", 2, 6, blocks=(3, 3, 3), head=4)], ids=lambda n: n.kind)
def test_gradients(network):
    rng = np.random.default_rng(0)
    state_ = {k: rng.normal(0, 0.5, v.shape) + (1.5 if "var" in k else 0) for k, v in network.initial(1).items()}
    x, y = rng.normal(size=(7, network.channels, network.length)), rng.integers(0, 2, 7)
    loss = lambda s: weighted(network, s, x, y)[0]
    _, gradients = weighted(network, state_, x, y)
    for key, g in gradients.items():
        for i in np.ndindex(state_[key].shape):
            up, down = ({**state_, key: state_[key].copy()} for _ in range(2))
            up[key][i] += 1e-5
            down[key][i] -= 1e-5
            assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(np.reshape(g, state_[key].shape)[i], abs=1e-5)


def weighted(network, s, x, y):
    logits, back, _ = network.forward(s, x)
    loss, g = networks.weighted_loss(logits, y, 3.0)
    return loss, back(g)


def test_local_rules():
    network = networks.Network("cnn", 1, 4)
    x = np.array([[[i + j for j in range(4)]] for i in range(4)], dtype=np.float32)
    y, start = np.array([0, 1, 0, 1]), network.initial(3)
    plain = federated.train_client(federated.Training(network, rate=0.01, batch=2), x, y, start, seed=5)
    control = federated.train_client(federated.Training(network, method="scaffold", rate=0.01, batch=2), x, y, start, seed=5)
    for k in start:
        assert control.state[k] == pytest.approx(plain.state[k])
        assert control.control[k] == pytest.approx((start[k] - control.state[k]) / (2 * 0.01), abs=1e-4)
    near = federated.train_client(federated.Training(network, method="fedprox", mu=100.0, rate=0.001, batch=2), x, y, start, seed=5)
    far = federated.train_client(federated.Training(network, rate=0.001, batch=2), x, y, start, seed=5)
    drift = lambda s: sum(float(((s[k] - start[k]) ** 2).sum()) for k in s)
    assert drift(near.state) < drift(far.state)
    with pytest.raises(ValueError):
        federated.Training(network, mu=-1)


def test_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(c, f"H{c % 2}", s, i, [[float(v)] for v in x], int(x[0] > 0)) for c in range(4) for i in range(60) for x in [rng.normal(size=2)] for s in [("train", "validation", "test")[i % 3]]]
    examples = spark.createDataFrame(rows, "client long, subcluster_id string, split string, example long, features array<array<double>>, label int")
    training = federated.Training(networks.Network("mlp", 2, dropout=0.0), rate=0.02, adam=True, batch=16, epochs=5)
    metrics, last, own = federated.run_rounds(examples, training, 3)
    assert [m["round"] for m in metrics] == [1, 2, 3] and metrics[-1]["train_loss_local_mean"] < metrics[0]["train_loss_local_mean"]
    assert metrics[-1]["test_f1"] > 0.8 and metrics[-1]["test_auroc"] > 0.8 and set(scoring.ROUND_COLUMNS) == metrics[-1].keys() and own is None
    # the first round equals clients trained by hand
    shared = training.network.initial(training.seed)
    sums, total = {}, 0
    for c in range(4):
        own = [r for r in rows if r[0] == c and r[2] == "train"]
        local = federated.train_client(training, np.array([r[4] for r in own], np.float32), np.array([r[5] for r in own]), shared, seed=training.seed + 1000 + 100 * (c % 2) + c // 2)
        total += len(own)
        sums = {k: sums.get(k, 0) + v * len(own) for k, v in local.state.items()}
    _, first, _ = federated.run_rounds(examples, training, 1)
    for k in first:
        assert first[k] == pytest.approx(sums[k] / total, abs=1e-5)


@pytest.mark.parametrize("method", ["fedbn", "scaffold"])
def test_second_round_by_hand(spark, method):
    """What a client keeps from the first round takes part in the second as when clients are trained by hand."""
    rng = np.random.default_rng(2)
    rows = [(c, f"H{c // 2}", "train", i, [[float(v) for v in x[k : k + 4]] for k in (0, 4)], int(x[0] > 0)) for c in range(3) for i in range(12 + c) for x in [rng.normal(size=8)]]
    examples = spark.createDataFrame(rows, "client long, subcluster_id string, split string, example long, features array<array<double>>, label int")
    training = federated.Training(networks.Network("cnn", 2, 4) if method == "scaffold" else networks.Network("tcn", 2, 4, blocks=(3, 3, 3), head=3, dropout=0.0), method=method, rate=0.05, batch=8)
    state, server, own, controls = training.network.initial(training.seed), {}, {}, {}
    for number in (1, 2):
        found, weights = {}, {}
        for c in range(3):
            part = [r for r in rows if r[0] == c]
            found[c] = federated.train_client(training, np.array([r[4] for r in part], np.float32), np.array([r[5] for r in part]), state, own=own.get(c), server=server, control=controls.get(c), seed=training.seed + 1000 * number + 100 * (c // 2) + c % 2)
            weights[c] = len(part)
        mean = {k: sum(found[c].state[k] * weights[c] for c in found) / sum(weights.values()) for k in state}
        if method == "fedbn":
            own = {c: found[c].state for c in found}
            mean = {k: state[k] if federated.is_batch_norm(k) else v for k, v in mean.items()}
        else:
            server = {k: server.get(k, 0) + sum(found[c].control[k] - controls.get(c, {}).get(k, 0) for c in found) / 3 for k in state}
            controls = {c: found[c].control for c in found}
        state = mean
    _, last, kept = federated.run_rounds(examples, training, 2)
    for k in last:
        assert last[k] == pytest.approx(state[k], abs=1e-5), k
    assert (kept is not None) == (method == "fedbn")


def test_incomplete_state():
    network = networks.Network("mlp", 2)
    rows = [{"key": k, "idx": i, "value": 0.0} for k, s in network.shapes().items() for i in range(int(np.prod(s)))]
    assert federated.to_state(rows, network).keys() == network.shapes().keys()
    with pytest.raises(state.AggregationError):
        federated.to_state(rows[:-1], network)


def test_ward_and_membership(spark, tmp_path):
    points = np.array([[0.0], [0.2], [10.0], [10.1], [50.0]])
    assert grouping.ward(points, 3) == [0, 0, 1, 1, 2] and grouping.ward(points, 5) == [0, 1, 2, 3, 4] and grouping.ward(points, 1) == [0] * 5
    record = grouping.membership_record([("C1_L001", "H1"), ("C1_L002", "H2")], cluster=1, dataset="x", group_ids=["H1", "H2"], reuse=["B", "P"])
    path = str(tmp_path / "m.json")
    open(path, "w").write(json.dumps(record))
    expected = spark.createDataFrame([("C1_L001",), ("C1_L002",)], "client_id string")
    assert grouping.read_membership(spark, path, cluster=1, groups=2, expected=expected).count() == 2
    for change in ({"frozen": False}, {"cluster_id": 2}, {"reuse_for_experiment_groups": ["B"]}, {"clients": record["clients"][:1]}):
        open(path, "w").write(json.dumps(record | change))
        with pytest.raises(grouping.MembershipError):
            grouping.read_membership(spark, path, cluster=1, groups=2)


def test_reports(spark):
    runs = spark.createDataFrame([("A", s, str(v)) for s, v in ((42, 0.8), (123, 0.9), (2025, 1.0))] + [("B", 42, "metric_unavailable_single_class")], "experiment_id string, seed int, acc string")
    found = {r.experiment_id: r for r in reports.mean_std(runs, ["acc"]).collect()}
    assert found["A"]["std"] == pytest.approx(0.08164965809277258) and found["B"]["mean"] is None and found["B"].display == "NOT AVAILABLE"
    axes = {c: list(range(n)) for c, n in zip("abcdefghi", (4, 2, 2, 2, 2, 3, 2, 4, 4))}
    assert reports.trial_grid(spark, axes).count() == 6144
    matrix = spark.createDataFrame([("x", "[[8,2],[1,9]]"), ("y", None), ("z", "[[1]]")], "experiment_id string, m string")
    assert [(r.tn, r.fp, r.fn, r.tp, r.status) for r in reports.confusion_report(matrix, "m").orderBy("experiment_id").collect()] == [(8, 2, 1, 9, "ok")] + [(None,) * 4 + ("missing_confusion_matrix",)] * 2
    rounds = spark.createDataFrame([("e", 1, 1), ("e", 1, 2), ("e", 2, 1)], "experiment_id string, seed int, round int")
    assert reports.unaligned_rounds(rounds).count() == 1


def record(spark, **change):
    base = {"round_id": 1, "cluster_id": 1, "cluster_head_id": "MC1_HEAD", "model_version": "C1_R001", "previous_main_model_hash": None, "new_main_model_hash": "sha256:" + "a" * 64, "clustering_method": "ward", "clustering_configuration_hash": "sha256:" + "b" * 64, "subcluster_count": 2, "subcluster_membership_hash": "sha256:" + "c" * 64, "fl_method": "FedAvg", "aggregation_rule": "mean", "effective_sample_count": 10, "participant_count": 2, "timestamp_start": "2026-01-01T00:00:00Z", "timestamp_end": "2026-01-01T00:00:01+00:00", "submitter_identity": "MC1_HEAD"}
    values_ = base | change
    schema = ", ".join(f"{k} {ledger.FIELDS.get(k, 'string')}" for k in values_)
    return spark.createDataFrame([tuple(values_.values())], schema)


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.append(record(spark), path, role=ledger.HEAD_ROLE, identity="MC1_HEAD") == 1
    for change, role, who in (({"full_model_weights": "x"}, ledger.HEAD_ROLE, "MC1_HEAD"), ({}, "client", "MC1_HEAD"), ({}, ledger.HEAD_ROLE, "MC2_HEAD"), ({"participant_count": 11}, ledger.HEAD_ROLE, "MC1_HEAD"), ({"cluster_id": 4}, ledger.HEAD_ROLE, "MC1_HEAD"), ({"timestamp_end": "now"}, ledger.HEAD_ROLE, "MC1_HEAD"), ({"new_main_model_hash": "a"}, ledger.HEAD_ROLE, "MC1_HEAD")):
        with pytest.raises(ledger.LedgerError):
            ledger.append(record(spark, **change), path, role=role, identity=who)
    assert ledger.read(spark, path).count() == 1
    assert ledger.latency(ledger.read(spark, path)).first().mean_latency_ms == 1000.0
    chained = ledger.chain([{"round": 2, "f1": 0.5}, {"round": 1, "f1": 0.4}], experiment="A", cluster=1, digest="d")
    assert chained[0]["previous_main_model_hash"] is None and chained[1]["previous_main_model_hash"] == chained[0]["new_main_model_hash"]
    assert hashing.canonical_sha256({"b": 1e-05, "a": [np.float32(1)]}) == hashing.canonical_sha256({"a": [1.0], "b": 1e-05})


def test_profile_classes():
    found = profile.column_classes(["time", "sensor", "attack", "Attack_P1"], labels=["attack"], times=["Time"], leakage=["attack_p1"])
    assert found["retained"] == ["sensor"] and found["excluded"] == ["Attack_P1", "attack", "time"]


@pytest.mark.parametrize("count", [1, 2, 999, 1000])
def test_median_by_buckets(spark, monkeypatch, count):
    """The median is exact over many buckets, and no aggregate gathers all different values for it."""
    from statistics import median

    def gathers(column):
        raise AssertionError("F.median holds all different values in one task")

    monkeypatch.setattr(features.F, "median", gathers)
    values = [float(i * 7919 % 613) for i in range(count)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(count, None)], "pos long, f double")
    assert features.median(rows, "f") == median(values)
    assert features.median(rows.where("f IS NULL"), "f") is None
    if count > 2:
        assert features.fit_numeric(rows, ["f"]).kept["f"][0] == median(values)


@pytest.mark.parametrize(("width", "stride"), [(32, 8), (8, 8), (5, 3), (6, 4), (4, 6), (7, 1)])
def test_windows_of_panes(spark, width, stride):
    """Panes of a length that divides both give the windows of a plain count, whatever width and stride."""
    rng = random.Random(width * 10 + stride)
    groups = {(c, s): [int(rng.random() < 0.1) for _ in range(rng.choice([0, width - 1, width, width + 1, 97]))] for c in range(3) for s in ("train", "test")}
    rows = [(c, s, 1000 + i, y) for (c, s), ys in groups.items() for i, y in enumerate(ys)]
    found = features.window_labels(spark.createDataFrame(rows, "client int, split string, local_pos long, label int"), width=width, stride=stride).collect()
    wanted = [(c, s, 1000 + k * stride, k, max(ys[k * stride : k * stride + width])) for (c, s), ys in groups.items() for k in range((len(ys) - width) // stride + 1 if len(ys) >= width else 0)]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_vector_means_and_sums(spark):
    """Aggregates over arrays give what those over single elements give, whatever contributors and lengths."""
    rng = random.Random(4)
    rows = [(1, f"H{c % 3}", c, rng.randint(1, 9), k, [rng.gauss(0, 1) for _ in range(n)]) for c in range(20) for k, n in (("conv.weight", 5), ("bn1.weight", 1), ("bias", 0))]
    vectors = spark.createDataFrame(rows, "cluster_id int, subcluster_id string, contributor int, n long, key string, value array<double>")
    single = state.elements(vectors, "cluster_id", "subcluster_id", "contributor", "n")
    for batch_norm in (True, False):
        found = {(r.key, r.idx): (pytest.approx(r.value), r.n) for r in state.elements(state.two_level_vector_mean(vectors, batch_norm=batch_norm), "n").collect()}
        assert found == {(r.key, r.idx): (r.value, r.n) for r in state.two_level_mean(single, batch_norm=batch_norm).collect()} and len(found) == 5 + batch_norm
    sums = {(r.key, r.idx): pytest.approx(r.value) for r in state.elements(state.vector_sum(vectors)).collect()}
    assert sums == {(r.key, r.idx): r.value for r in state.sum_states(single).collect()}


def test_grouped_running_sums(spark):
    """Groups of any size over many ranges, null groups and ties: the sums of one window."""
    rng = random.Random(6)
    rows = [(g, i, rng.randint(0, 5)) for g, n in (("a", 300), (None, 40), ("b", 1), ("c", 90)) for i in rng.sample(range(1000), n)]
    frame = spark.createDataFrame(rows, "g string, p int, v int")
    for descending in (False, True):
        got = {(r.g, r.p): r.s for r in running.running_sums(frame, ["p"], {"s": F.col("v")}, by=("g",), descending=descending, buckets=7).collect()}
        assert got == {(g, p): sum(w for h, q, w in rows if h == g and (q >= p if descending else q <= p)) for g, p, _ in rows}
