"""An append-only, hash-chained ledger of rounds: records, rules, appending and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from plumbline.functions.hashing import canonical_sha256
from plumbline.functions.scalars import timestamp_of

_HASH = "^sha256:[0-9a-f]{64}$"
# The fields of a record, which readers of the log rely on.
FIELDS = {
    "round_id": "int", "cluster_id": "int", "cluster_head_id": "string", "model_version": "string", "previous_main_model_hash": "string", "new_main_model_hash": "string",
    "clustering_method": "string", "clustering_configuration_hash": "string", "subcluster_count": "int", "subcluster_membership_hash": "string", "fl_method": "string",
    "aggregation_rule": "string", "effective_sample_count": "long", "participant_count": "int", "timestamp_start": "string", "timestamp_end": "string", "submitter_identity": "string",
}
OPTIONAL = {"subcluster_digest": "string"}
SCHEMA = ", ".join(f"{n} {t}" for n, t in (FIELDS | OPTIONAL).items())
HEAD_ROLE = "main_cluster_head"


class LedgerError(ValueError):
    """A record or writer that the ledger refuses."""


def rules() -> dict[str, Column]:
    """What breaks each rule of a record."""
    c = F.col
    text = ["cluster_head_id", "model_version", "clustering_method", "fl_method", "aggregation_rule", "submitter_identity"]
    hashes = ["new_main_model_hash", "clustering_configuration_hash", "subcluster_membership_hash"]
    broken = {f"{n} is missing": c(n).isNull() for n in FIELDS if n != "previous_main_model_hash"}
    broken |= {f"{n} is empty": F.trim(n) == "" for n in text} | {f"{n} is no hash": ~c(n).rlike(_HASH) for n in hashes}
    broken |= {f"{n} is no time": timestamp_of(n).isNull() for n in ("timestamp_start", "timestamp_end")}
    return broken | {
        "previous_main_model_hash is no hash": c("previous_main_model_hash").isNotNull() & ~c("previous_main_model_hash").rlike(_HASH),
        "round_id below 1": c("round_id") < 1,
        "cluster_id outside 1 to 3": ~c("cluster_id").between(1, 3),
        "subcluster_count below 1": c("subcluster_count") < 1,
        "effective_sample_count below 1": c("effective_sample_count") < 1,
        "participant_count below 1": c("participant_count") < 1,
        "submitter is not the head": c("submitter_identity") != c("cluster_head_id"),
        "more participants than samples": c("participant_count") > c("effective_sample_count"),
    }


def violations(records: DataFrame) -> DataFrame:
    """round_id, cluster_id and broken, the list of broken rules, of the records that break any."""
    found = F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(n)) for n, v in rules().items()])
    return records.select("round_id", "cluster_id", F.filter(found, lambda x: x.isNotNull()).alias("broken")).where(F.size("broken") > 0)


def check_columns(columns: list[str]) -> None:
    """Raise for fields that a record must not have or lacks."""
    unknown, missing = sorted(set(columns) - FIELDS.keys() - OPTIONAL.keys()), sorted(FIELDS.keys() - set(columns))
    if missing:
        raise LedgerError(f"missing fields: {', '.join(missing)}")
    if unknown:
        raise LedgerError(f"fields that a record must not have: {', '.join(unknown)}")


def append(records: DataFrame, path: str, *, role: str, identity: str) -> int:
    """Append checked records as JSON lines and return how many were appended. Only a cluster's head may write, and only as itself.

    Rules and the writer's name are checked in one pass before anything is written; the number
    comes from the pass that writes, so an append does not read what the ledger has.
    """
    if role != HEAD_ROLE:
        raise LedgerError(f"role {role} may not write")
    check_columns(records.columns)
    found = F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(n)) for n, v in rules().items()])
    strange = (F.col("cluster_head_id") != identity) | (F.col("submitter_identity") != identity)
    checked = records.select("round_id", F.filter(found, lambda x: x.isNotNull()).alias("broken"), F.coalesce(strange, F.lit(True)).alias("strange")).where("size(broken) > 0 OR strange").limit(5).collect()
    bad = [(r.round_id, r.broken) for r in checked if r.broken]
    if bad:
        raise LedgerError(f"records break rules: {bad}")
    if checked:
        raise LedgerError("the writer is not the head that the record names")
    written = Observation()
    records.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return written.get["n"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a ledger; a line that is no record of its schema fails the read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def chain(rows: list[dict], *, experiment: str, cluster: int, digest: str) -> list[dict]:
    """Previous and new hash of each round in order. For the rounds of one run, which are few and depend on each other."""
    previous, out = None, []
    for row in sorted(rows, key=lambda r: r["round"]):
        new = canonical_sha256([experiment, cluster, row["round"], previous, row, digest])
        out.append({"round_id": row["round"], "previous_main_model_hash": previous, "new_main_model_hash": new})
        previous = new
    return out


def previous_hash(new: str, *, by=("cluster_id",), order: str = "round_id") -> Column:
    """The new hash of the record before; for ledgers of few records a cluster, see ``broken_links`` for any size."""
    return F.lag(new).over(Window.partitionBy(*by).orderBy(order))


def with_previous(records: DataFrame, *, by=("cluster_id",), order: str = "round_id", new: str = "new_main_model_hash", span: int = 100_000) -> DataFrame:
    """``records`` with ``expected``, the new hash of the record before, null for the first one of a cluster.

    Records meet in stretches of ``span`` round numbers, not by cluster. Each stretch hands the hash
    of its last record on to the next one of its cluster, over one row per stretch.
    """
    rows = records.withColumn("__stretch", F.floor(F.col(order) / F.lit(span)))
    last = rows.groupBy(*by, "__stretch").agg(F.max_by(new, order).alias("__last"))
    carried = last.select(*by, "__stretch", F.lag("__last").over(Window.partitionBy(*by).orderBy("__stretch")).alias("__carried"))
    stretch = Window.partitionBy(*by, "__stretch").orderBy(order)
    rows = rows.withColumns({"__inside": F.lag(new).over(stretch), "__first": F.row_number().over(stretch) == 1}).join(carried, [*by, "__stretch"])
    return rows.select(*records.columns, F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__inside")).alias("expected"))


def broken_links(records: DataFrame, *, by=("cluster_id",), order: str = "round_id", new: str = "new_main_model_hash", previous: str = "previous_main_model_hash", span: int = 100_000) -> DataFrame:
    """The records whose previous hash is not the new hash of the record before, by ``with_previous``; the first one must have none."""
    return with_previous(records, by=by, order=order, new=new, span=span).where(~F.col(previous).eqNullSafe(F.col("expected")))


def latency(records: DataFrame, *, by=("cluster_id",), start: str = "timestamp_start", end: str = "timestamp_end") -> DataFrame:
    """Records and mean milliseconds from start to end."""
    spent = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / F.lit(1000.0)
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.avg(spent).alias("mean_latency_ms"))
