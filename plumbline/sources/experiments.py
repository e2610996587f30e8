"""Experiment tables: the matrix of runs, the registry in configuration files, metrics and artifacts."""

from __future__ import annotations

import json
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions.scalars import is_missing, retyped, trimmed
from plumbline.sources.contract import ContractError
from plumbline.sources.files import read_text

#: Columns that an experiment matrix must have.
MATRIX_COLUMNS = ("experiment_id", "cluster_id", "model_family", "fl_method", "hierarchy", "aggregation")


def read_matrix(spark: SparkSession, path: str, required=MATRIX_COLUMNS) -> DataFrame:
    """The matrix as trimmed text; ids must be there and differ."""
    rows = spark.read.option("header", True).csv(path)
    lacking = [c for c in required if c not in rows.columns]
    if lacking:
        raise ContractError(f"{path} lacks columns: {', '.join(lacking)}")
    rows = rows.select(*(trimmed(c).alias(c) for c in rows.columns))
    bad = rows.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).where("experiment_id = '' OR n > 1").limit(5).collect()
    if bad:
        raise ContractError(f"blank or repeated experiment ids: {[r.experiment_id for r in bad]}")
    return rows


def read_registry(spark: SparkSession, paths: list[str], fields: list[str], *, section: str = "experiments") -> DataFrame:
    """The entries of the ``section`` lists of YAML files as one table of text; of ablation files, only AB_ entries count."""
    rows = []
    for path in paths:
        text = yaml.safe_load(read_text(path))
        for entry in text.get(section, []) if isinstance(text, dict) else []:
            if "ablation" not in Path(path).name or str(entry.get("experiment_id", "")).startswith("AB_"):
                rows.append(tuple(None if entry.get(f) is None else str(entry[f]) for f in fields))
    ids = [r[fields.index("experiment_id")] for r in rows]
    if len(set(ids)) != len(ids):
        raise ContractError(f"repeated experiment ids: {sorted({i for i in ids if ids.count(i) > 1})}")
    return spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields))


_NESTED = "experiment_group string, clusters array<map<string,string>>, comparisons array<struct<control: map<string,string>>>"


def _documents(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """YAML files on any store as rows of path and ``d``, what of them fits the schema."""
    texts = [(p, json.dumps(yaml.safe_load(read_text(p)), default=str)) for p in paths]
    return spark.createDataFrame(texts, "path string, text string").select("path", F.from_json("text", schema).alias("d"))


def nested_registry(spark: SparkSession, paths: list[str], *, root: str) -> DataFrame:
    """The entries of nested YAML files: experiment_id, experiment_group, config, cluster_config, cluster_id, dataset_name, entry.

    A file has an experiment_group and a list of clusters, each entry of which is an experiment, or
    a list of comparisons, of which the control arms named AB_ count. The cluster_config of an
    entry, a path under ``root``, tells the cluster and the dataset. ``entry`` is a map of text.
    Raises for files with neither list, entries without id or configuration, and repeated ids.
    """
    read = _documents(spark, paths, _NESTED)
    empty = read.where("coalesce(size(d.clusters), 0) + coalesce(size(d.comparisons), 0) = 0 OR (coalesce(size(d.clusters), 0) > 0 AND coalesce(trim(d.experiment_group), '') = '')").limit(5).collect()
    if empty:
        raise ContractError(f"files without experiments or their group: {[r.path for r in empty]}")
    whole = read.select("path", F.col("d.experiment_group").alias("experiment_group"), F.explode("d.clusters").alias("entry"))
    arms = read.select("path", F.lit("ablation_fl_method").alias("experiment_group"), F.explode("d.comparisons.control").alias("entry")).where(F.coalesce(F.col("entry")["experiment_id"], F.lit("")).startswith("AB_"))
    rows = whole.union(arms).select(F.trim(F.col("entry")["experiment_id"]).alias("experiment_id"), "experiment_group", F.col("path").alias("config"), F.concat(F.lit(f"{root.rstrip('/')}/"), F.col("entry")["cluster_config"]).alias("cluster_config"), "entry")
    bad = rows.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster_config").isNull()).alias("without")).where("experiment_id IS NULL OR experiment_id = '' OR n > 1 OR without > 0").limit(5).collect()
    if bad:
        raise ContractError(f"entries without id or configuration, or repeated: {sorted(str(r.experiment_id) for r in bad)}")
    clusters = _documents(spark, sorted({r.cluster_config for r in rows.select("cluster_config").distinct().collect()}), "cluster struct<id: int, dataset_name: string>")
    clusters = clusters.select(F.col("path").alias("cluster_config"), F.col("d.cluster.id").alias("cluster_id"), F.col("d.cluster.dataset_name").alias("dataset_name"))
    unnamed = clusters.where("cluster_id IS NULL OR dataset_name IS NULL").limit(5).collect()
    if unnamed:
        raise ContractError(f"files without a cluster's id and dataset: {[r.cluster_config for r in unnamed]}")
    return rows.join(clusters, "cluster_config").select("experiment_id", "experiment_group", "config", "cluster_config", "cluster_id", "dataset_name", "entry")


def read_metrics(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """Round or summary metrics; the numeric columns as doubles, null for blanks and for unavailable ones."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*(retyped(c).alias(c) if c in numeric else F.when(~is_missing(c), trimmed(c)).alias(c) for c in rows.columns))


def read_one_row(spark: SparkSession, path: str, numeric: list[str]):
    """The single row of a summary; anything else is an error."""
    rows = read_metrics(spark, path, numeric).limit(2).collect()
    if len(rows) != 1:
        raise ContractError(f"{path} must have exactly one row")
    return rows[0]


def artifact_listing(spark: SparkSession, root: str) -> DataFrame:
    """experiment_id, seed and kind (failed, metrics or other) of the files under root/<experiment>/seed_<n>/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    name = F.regexp_extract("path", r"([^/]+)/seed_(\d+)/[^/]+$", 1)
    kind = F.when(F.col("path").rlike(r"FAILED[^/]*$"), "failed").when(F.col("path").rlike(r"metrics[^/]*\.csv$"), "metrics").otherwise("other")
    return files.select(name.alias("experiment_id"), F.regexp_extract("path", r"/seed_(\d+)/", 1).try_cast("long").alias("seed"), kind.alias("kind")).where("experiment_id <> ''")


def select_experiments(known: list[str], *, explicit=(), suite: str | None = None, everything: bool = False) -> list[str]:
    """The wanted ids in order, each once: exactly one of a list, a prefix or all."""
    if bool(explicit) + bool(suite) + everything != 1:
        raise ContractError("choose experiments by id, by suite, or all")
    wanted = list(dict.fromkeys(explicit)) if explicit else [k for k in known if everything or k.startswith(f"{suite}_")]
    unknown = [w for w in wanted if w not in known]
    if unknown or not wanted:
        raise ContractError(f"unsupported experiments: {', '.join(unknown) or suite}")
    return wanted
