"""Rounds of local training and two-level weighted means, one Spark job per round.

Examples stay on the executors: a client is one group of a DataFrame, trained in the task that has
it, so a client should have no more examples than a task holds. What goes out is the averaged state
of the network; what comes back is a long table, written once per round. What belongs to a client
(FedBN's batch-norm state, SCAFFOLD's control variate) stays in that table and meets the client's
examples in the next round by a cogroup, so the driver holds one state, however many clients there
are. States are averaged by ``plumbline.operators.state``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.scalars import BATCH_NORM
from plumbline.operators import scoring, state as states
from plumbline.operators.networks import Network, State, probabilities, weighted_loss
from plumbline.sources.files import remove, workspace

METHODS = ("fedavg", "fedprox", "scaffold", "fedbn")


@dataclass(frozen=True)
class Training:
    """How a client trains: SGD, or Adam with moments that start anew each time."""

    network: Network
    method: str = "fedavg"
    rate: float = 0.05
    batch: int = 128
    epochs: int = 1
    adam: bool = False
    mu: float = 0.01
    positive_weight: float = 1.0
    seed: int = 42

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method}")
        if self.mu < 0 or self.rate <= 0 or self.batch < 1:
            raise ValueError("mu must not be negative; rate and batch must be positive")


def is_batch_norm(key: str) -> bool:
    return any(mark in key.lower() for mark in BATCH_NORM)


@dataclass
class Local:
    """What a client returns: its state, mean loss and, for SCAFFOLD, its new control variate."""

    state: State
    loss: float
    control: State = field(default_factory=dict)


def train_client(training: Training, x: np.ndarray, y: np.ndarray, shared: State, *, own: State | None = None, server: State | None = None, control: State | None = None, seed: int = 0) -> Local:
    """Train on one client's examples from the shared state.

    FedBN starts batch-norm keys from the client's own state. FedProx adds mu times the distance
    from the shared state to each gradient. SCAFFOLD corrects each step by the server's control
    variate less the client's, and renews the client's from the way that it went.
    """
    start = shared if not own else {k: own.get(k, v) if is_batch_norm(k) else v for k, v in shared.items()}
    current, rng = {k: v.astype(np.float64) for k, v in start.items()}, np.random.default_rng(seed)
    server, control = server or {}, control or {}
    first, second, steps, losses = {}, {}, 0, []
    for _ in range(training.epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), training.batch):
            part = order[at : at + training.batch]
            logits, back, fresh = training.network.forward(current, x[part], rng)
            loss, gradient = weighted_loss(logits, y[part], training.positive_weight)
            if training.method == "fedprox":
                loss += training.mu / 2 * sum(float(((current[k] - shared[k]) ** 2).sum()) for k in current)
            steps += 1
            for k, g in back(gradient).items():
                g = g.reshape(current[k].shape)
                if training.method == "fedprox":
                    g = g + training.mu * (current[k] - shared[k])
                elif training.method == "scaffold":
                    g = g - control.get(k, 0.0) + server.get(k, 0.0)
                if training.adam:
                    first[k] = 0.9 * first.get(k, 0.0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0.0) + 0.001 * g * g
                    g = first[k] / (1 - 0.9**steps) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
                current[k] = current[k] - training.rate * g
            current |= fresh
            losses.append(loss)
    mean = sum(losses) / len(losses)  # of the means of batches, whatever the size of the last one
    renewed = {}
    if training.method == "scaffold":
        renewed = {k: control.get(k, 0.0) - server.get(k, 0.0) + (start[k] - current[k]) / (steps * training.rate) for k in current}
    return Local({k: v.astype(np.float32) for k, v in current.items()}, mean, {k: np.asarray(v, np.float32) for k, v in renewed.items()})


def _tensor(column: pd.Series, network: Network) -> np.ndarray:
    rows = np.array([np.stack(v) if network.kind != "mlp" and len(v) and np.ndim(v[0]) else np.asarray(v, np.float32) for v in column], dtype=np.float32)
    return rows.reshape(len(rows), network.channels, -1)


def _rows(client: int, kind: str, arrays: State) -> list[tuple]:
    return [(client, kind, k, i, float(v)) for k, a in arrays.items() for i, v in enumerate(np.ravel(a))]


_UPDATE = "client long, subcluster_id string, n long, loss double, kind string, key string, idx int, value double"


def _of_client(rows: pd.DataFrame | None, kind: str, network: Network) -> State:
    """The arrays of one kind that a client has in the table of an earlier round; a key is whole or not there."""
    if rows is None:
        return {}
    shapes, rows = network.shapes(), rows[rows["kind"] == kind]
    return {k: part.sort_values("idx")["value"].to_numpy(np.float32).reshape(shapes[k]) for k, part in rows.groupby("key")}


def with_seed_places(examples: DataFrame, *, hierarchical: bool) -> DataFrame:
    """``examples`` with seed_place, which sets a client's seed apart: its place, or 100 for each sub-cluster before its own and its place in there."""
    clients = examples.select("client", "subcluster_id").distinct()
    inside = Window.partitionBy("subcluster_id").orderBy("client") if hierarchical else Window.orderBy("client")
    place = F.row_number().over(inside) - 1
    if hierarchical:
        place = place + 100 * (F.dense_rank().over(Window.orderBy("subcluster_id")) - 1)
    return examples.join(clients.select("client", "subcluster_id", place.cast("long").alias("seed_place")), ["client", "subcluster_id"])


def local_updates(examples: DataFrame, training: Training, shared: State, *, earlier: DataFrame | None = None, server: State | None = None, round_no: int = 1) -> DataFrame:
    """Train every client of ``examples`` (client, subcluster_id, seed_place, features, label): client, subcluster_id, n, loss, kind, key, idx, value.

    kind is state or control. ``earlier`` is the table of the round before, from which a client
    takes what is its own. A client's seed comes from the round and its place, never from the
    order of tasks.
    """
    known = examples.sparkSession.sparkContext.broadcast((shared, server))

    def train(group: pd.DataFrame, before: pd.DataFrame | None) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"client": [], "subcluster_id": [], "n": [], "loss": [], "kind": [], "key": [], "idx": [], "value": []})
        start, server_control = known.value
        client, sub = int(group["client"].iloc[0]), group["subcluster_id"].iloc[0]
        group = group.sort_values("example")
        own = _of_client(before, "state", training.network) if training.method == "fedbn" else {}
        control = _of_client(before, "control", training.network)
        seed = training.seed + 1000 * round_no + int(group["seed_place"].iloc[0])
        found = train_client(training, _tensor(group["features"], training.network), group["label"].to_numpy(), start, own=own, server=server_control, control=control, seed=seed)
        rows = _rows(client, "state", found.state) + _rows(client, "control", found.control)
        out = pd.DataFrame(rows, columns=["client", "kind", "key", "idx", "value"])
        return out.assign(subcluster_id=sub, n=len(group), loss=found.loss)[["client", "subcluster_id", "n", "loss", "kind", "key", "idx", "value"]]

    groups = examples.select("client", "subcluster_id", "seed_place", "example", "features", "label").groupBy("client")
    if earlier is None:
        return groups.applyInPandas(lambda group: train(group, None), _UPDATE)
    return groups.cogroup(earlier.select("client", "kind", "key", "idx", "value").groupBy("client")).applyInPandas(train, _UPDATE)


def to_state(rows: list, network: Network) -> State:
    """Arrays from collected (key, idx, value) rows, which must be all of the network's state and no more."""
    shapes = network.shapes()
    out = {k: np.zeros(int(np.prod(s)), np.float32) for k, s in shapes.items()}
    if {r["key"] for r in rows} != shapes.keys() or len(rows) != sum(map(len, out.values())):
        raise states.AggregationError("the rows are not a whole state of the network")
    for r in rows:
        out[r["key"]][r["idx"]] = r["value"]
    return {k: out[k].reshape(s) for k, s in shapes.items()}


def _table(spark: SparkSession, arrays: State) -> DataFrame:
    return spark.createDataFrame([r[2:] for r in _rows(0, "state", arrays)], "key string, idx int, value double")


def predictions(examples: DataFrame, network: Network, shared: State, own: DataFrame | None = None) -> DataFrame:
    """client, split, label, p of every example; batch-norm keys from the client's rows in ``own`` (client, kind, key, idx, value) if it is given."""
    known = examples.sparkSession.sparkContext.broadcast(shared)
    rows, schema = examples.select("client", "split", "label", "features"), "client long, split string, label int, p double"

    def score(part: pd.DataFrame, state: State) -> pd.DataFrame:
        logits, _, _ = network.forward(state, _tensor(part["features"], network))
        return part[["client", "split", "label"]].assign(p=probabilities(logits))

    if own is None:
        return rows.mapInPandas(lambda frames: (score(f, known.value) for f in frames if len(f)), schema)

    def run(part: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"client": [], "split": [], "label": [], "p": []})
        local = _of_client(mine, "state", network)
        return score(part, {k: local.get(k, v) if is_batch_norm(k) else v for k, v in known.value.items()})

    return rows.groupBy("client").cogroup(own.select("client", "kind", "key", "idx", "value").groupBy("client")).applyInPandas(run, schema)


def run_rounds(examples: DataFrame, training: Training, rounds: int, *, hierarchical: bool = True) -> tuple[list[dict], State, DataFrame | None]:
    """The row of each round (``scoring.ROUND_COLUMNS``), the last state and, for FedBN, what belongs to each client.

    ``examples`` has client, subcluster_id, split, example (its place), features and label, and is
    cached while rounds run. Each round trains all clients in one job whose table is written to the
    shared workspace, checks and averages it by sub-cluster and over sub-clusters (flat: one
    sub-cluster), and scores every split.
    """
    network, spark = training.network, examples.sparkSession
    if not hierarchical:
        examples = examples.withColumn("subcluster_id", F.lit("all"))
    examples = with_seed_places(examples, hierarchical=hierarchical).cache()
    clients = examples.select("client").distinct().count()
    state, earlier, own = network.initial(training.seed), None, None
    server = {k: np.zeros(s, np.float32) for k, s in network.shapes().items()} if training.method == "scaffold" else None
    elements = sum(int(np.prod(s)) for s in network.shapes().values())
    links = clients + (examples.select("subcluster_id").distinct().count() if hierarchical else 0)
    # both ways over each link, and SCAFFOLD's control variates along with the state
    cost = 4 * elements * 2 * links * (2 if training.method == "scaffold" else 1)
    metrics, train, behind = [], examples.where("split = 'train'"), None
    for number in range(1, rounds + 1):
        path = workspace(spark, f"round-{number}")
        local_updates(train, training, state, earlier=earlier, server=server, round_no=number).write.parquet(path)
        updates = spark.read.parquet(path)
        weights = updates.where("kind = 'state'").select(F.lit(1).alias("cluster_id"), "subcluster_id", F.col("client").alias("contributor"), "n", "key", "idx", "value")
        states.check_updates(weights)
        mean = states.two_level_mean(weights).select("key", "idx", "value")
        if training.method == "fedbn":
            mean, own = states.replace_state(_table(spark, state), mean), updates
        mean = to_state(mean.collect(), network)
        if training.method == "scaffold":
            new = updates.where("kind = 'control'").select("client", "key", "idx", "value")
            if earlier is not None:
                before = earlier.where("kind = 'control'").select("client", "key", "idx", F.col("value").alias("__before"))
                new = new.join(before, ["client", "key", "idx"], "left").select("client", "key", "idx", (F.col("value") - F.coalesce("__before", F.lit(0.0))).alias("value"))
            server = to_state(states.server_control(_table(spark, server), new, clients).collect(), network)
        losses = updates.groupBy("client", "subcluster_id").agg(F.first("loss").alias("loss")).groupBy("subcluster_id").agg(F.avg("loss").alias("loss")).agg(F.avg("loss")).first()[0]
        state, earlier = mean, updates
        scores = scoring.round_row(scoring.evaluate(predictions(examples, network, state, own))).first().asDict()
        metrics.append({"round": number, "train_loss_local_mean": losses, "communication_cost_bytes": cost} | scores)
        if behind:  # nothing reads the round before any more
            remove(behind)
        behind = path
    examples.unpersist()
    return metrics, state, own
