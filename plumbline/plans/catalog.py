"""The registered queries over the generated tables, each with its DuckDB counterpart.

``events`` is the ordered stream, an error being the positive class; ``labels`` with ``documents``
are the scored set, with the number of characters over 20,000 as the score; ``embeddings`` are the
state vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import scalars as S
from plumbline.operators import features, grouping, ledger, profile, reports, running, scoring, sharding, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- shared inputs ---------------------------------------------------------------------------

CLIENTS = 12
_LABEL = "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"
_ORDERED = f"""
o AS (SELECT *, {_LABEL} AS label, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
c AS (SELECT *, ((pos + 1) * 12 - 1) // n AS client FROM o),
l AS (SELECT *, pos - (client * n) // 12 AS local_pos, ((client + 1) * n) // 12 - (client * n) // 12 AS m FROM c),
b AS (SELECT *, least(m, greatest(1, CAST(floor(m * CAST(0.7 AS DOUBLE)) AS BIGINT))) AS train_end FROM l),
v AS (SELECT *, least(m, greatest(train_end, CAST(floor(m * CAST(0.85 AS DOUBLE)) AS BIGINT))) AS val_end FROM b),
s AS (SELECT *, CASE WHEN local_pos < train_end THEN 'train' WHEN local_pos < val_end THEN 'validation' ELSE 'test' END AS split FROM v)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("label", F.when(F.col("event_type") == "error", 1).otherwise(0))


def sharded(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """events in order of time, in 12 shards with splits; only the named columns beside the keys are read."""
    return sharding.shard_and_split(events(spark, sf_dir).select("ts", "event_id", "label", *columns), ["ts", "event_id"], CLIENTS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.least(F.col("n_chars"), F.lit(20000)) / 20000.0).alias("p"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).join(docs, "doc_id")


_SCORED = "sc AS (SELECT l.doc_id, l.quality AS label, least(d.n_chars, 20000) / CAST(20000.0 AS DOUBLE) AS p FROM labels l JOIN documents d USING (doc_id))"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as client updates: one contributor per vector, in sub-clusters by label, key by quarter of the vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("at", "v"))
    names = F.array(*[F.lit(n) for n in ("conv.weight", "block1.bn.weight", "dense_bias", "bn1.running_mean")])
    return rows.select(F.lit(1).alias("cluster_id"), F.col("label").alias("subcluster_id"), F.col("vec_id").alias("contributor"), (F.col("vec_id") % 7 + 1).alias("n"), F.element_at(names, (F.floor(F.col("at") / 16) + 1).cast("int")).alias("key"), (F.col("at") % 16).alias("idx"), F.col("v").cast("double").alias("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same updates with the array of a key in one row."""
    keys = ("conv.weight", "block1.bn.weight", "dense_bias", "bn1.running_mean")
    parts = F.array(*[F.struct(F.lit(k).alias("key"), F.transform(F.slice("embedding", 16 * i + 1, 16), lambda x: x.cast("double")).alias("value")) for i, k in enumerate(keys)])
    return table(spark, sf_dir, "embeddings").select(F.lit(1).alias("cluster_id"), F.col("label").alias("subcluster_id"), F.col("vec_id").alias("contributor"), (F.col("vec_id") % 7 + 1).alias("n"), F.inline(parts))


_STATES = """st AS (SELECT 1 AS cluster_id, label AS subcluster_id, vec_id AS contributor, vec_id % 7 + 1 AS n,
  ['conv.weight', 'block1.bn.weight', 'dense_bias', 'bn1.running_mean'][i // 16 + 1] AS key, CAST(i % 16 AS INTEGER) AS idx, CAST(embedding[i + 1] AS DOUBLE) AS value
  FROM embeddings, unnest(range(0, 64)) t(i))"""


def _rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


# --- profiles and contracts ------------------------------------------------------------------


@query(
    " UNION ALL ".join(
        f"""SELECT 'events' AS file, '{c}' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE lower(trim(coalesce(CAST({c} AS VARCHAR), ''))) IN ('', 'na', 'n/a', 'nan', 'null', 'none')) AS n_missing,
count(*) FILTER (WHERE lower(trim(coalesce(CAST({c} AS VARCHAR), ''))) NOT IN ('', 'na', 'n/a', 'nan', 'null', 'none')) AS n_present, {numeric} AS is_numeric FROM events"""
        for c, numeric in (("event_id", "true"), ("user_id", "true"), ("event_type", "false"), ("value", "true"), ("props", "false"))
    )
)
def profile_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("events").alias("file"), "event_id", "user_id", "event_type", "value", "props")
    return profile.profile_columns(rows, by=("file",))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type")
def label_histogram(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "events"), "event_type")


_RAW_LABEL = "CASE event_id % 8 WHEN 0 THEN ' Normal ' WHEN 1 THEN 'ATTACK' WHEN 2 THEN '0' WHEN 3 THEN '1.0' WHEN 4 THEN 'benign' WHEN 5 THEN 'true' WHEN 6 THEN '2' ELSE 'anomaly' END"


@query(f"""WITH r AS (SELECT {_RAW_LABEL} AS raw FROM events)
SELECT raw, CASE WHEN raw IN (' Normal ', '0', 'benign') THEN '0' WHEN raw IN ('ATTACK', '1.0', 'anomaly') THEN '1' ELSE 'rejected' END AS label,
CASE WHEN raw IN (' Normal ', '0', 'benign') THEN '0' WHEN raw IN ('ATTACK', 'true', 'anomaly') THEN '1' ELSE 'rejected' END AS profiler_label, count(*) AS n FROM r GROUP BY raw""")
def label_binary_map(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.expr(_RAW_LABEL).alias("raw"))
    return raw.groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select("raw", *(F.coalesce(f("raw").cast("string"), F.lit("rejected")).alias(c) for c, f in (("label", S.binary_label), ("profiler_label", S.profile_label))), "n")


@query(f"""WITH r AS (SELECT {_RAW_LABEL} AS raw FROM events) SELECT raw, count(*) AS n FROM r WHERE raw IN ('true', '2') GROUP BY raw""")
def unknown_labels(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.expr(_RAW_LABEL).alias("raw"))
    return raw.where(S.binary_label("raw").isNull()).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))


_CELL = "CASE event_id % 10 WHEN 0 THEN '' WHEN 1 THEN ' NA ' WHEN 2 THEN '1_000' WHEN 3 THEN '1d' WHEN 4 THEN '.5' WHEN 5 THEN '1e3' WHEN 6 THEN '0x10' WHEN 7 THEN ' -7 ' WHEN 8 THEN 'NaN' ELSE 'abc' END"


@query(f"""WITH r AS (SELECT DISTINCT {_CELL} AS cell FROM events)
SELECT cell, lower(trim(cell)) IN ('', 'na', 'n/a', 'nan', 'null', 'none') AS missing,
CASE trim(cell) WHEN '1_000' THEN CAST(1000 AS DOUBLE) WHEN '.5' THEN CAST(0.5 AS DOUBLE) WHEN '1e3' THEN CAST(1000 AS DOUBLE) WHEN '-7' THEN CAST(-7 AS DOUBLE) END AS number,
CASE WHEN lower(trim(cell)) IN ('', 'na', 'nan') THEN 'UNKNOWN' ELSE trim(cell) END AS category FROM r""")
def cell_rules(spark, sf_dir):
    cells = table(spark, sf_dir, "events").select(F.expr(_CELL).alias("cell")).distinct()
    return cells.select("cell", S.is_missing("cell").alias("missing"), S.feature_number("cell").alias("number"), S.category("cell").alias("category"))


@query("""SELECT 'customer' AS source, CAST(c_custkey AS VARCHAR) AS "key", c_name AS name, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def harmonized_union(spark, sf_dir):
    from plumbline.sources.harmonise import harmonised

    parts = {"customer": table(spark, sf_dir, "customer").selectExpr("c_custkey key", "c_name name", "c_mktsegment segment", "c_nationkey nation"), "supplier": table(spark, sf_dir, "supplier").selectExpr("s_suppkey key", "s_name name", "s_nationkey nation")}
    return harmonised(parts, shared=["key"], last=["nation"]).select("source", "key", "name", "segment", "nation")


_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
}
_FILLED = "f AS (" + " UNION ALL ".join(f"""SELECT '{t}' AS file, '{c[2:]}' AS col FROM {t} HAVING count("{c}") > 0""" for t, cs in _COLUMNS.items() for c in cs) + ")"


def _filled_columns(spark, sf_dir) -> DataFrame:
    """(file, column) of the columns that have a value, of four tables; names without their table's letter."""
    found = []
    for name in _COLUMNS:
        rows = table(spark, sf_dir, name)
        counts = rows.agg(F.array(*[F.struct(F.lit(c[2:]).alias("column"), F.count(c).alias("n")) for c in rows.columns]).alias("columns"))
        found.append(counts.select(F.lit(name).alias("file"), F.inline("columns")).where("n > 0").drop("n"))
    return reduce(DataFrame.union, found)


@query(f"""WITH {_FILLED} SELECT col AS "column", count(DISTINCT file) AS n_files, count(DISTINCT file) = 4 AS in_all FROM f GROUP BY col""")
def schema_union_intersection(spark, sf_dir):
    return profile.schema_rollup(_filled_columns(spark, sf_dir))


@query(f"""WITH {_FILLED} SELECT x.file, y.col AS "column", EXISTS (SELECT 1 FROM f WHERE f.file = x.file AND f.col = y.col) AS present FROM (SELECT DISTINCT file FROM f) x, (SELECT DISTINCT col FROM f) y""")
def column_incidence(spark, sf_dir):
    return profile.incidence(_filled_columns(spark, sf_dir))


# --- order, shards, splits -------------------------------------------------------------------


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def ordered_positions(spark, sf_dir):
    return running.positions(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "pos")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM events")
def ordered_positions_bucketed(spark, sf_dir):
    return running.positions(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"], buckets=16).select("event_id", "pos")


@query(f"""WITH {_ORDERED} SELECT client, split, count(*) AS n_rows, count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives,
count(*) FILTER (WHERE label = 0) = 0 OR count(*) FILTER (WHERE label = 1) = 0 AS single_class FROM s GROUP BY client, split""")
def shard_split_counts(spark, sf_dir):
    return sharding.split_counts(sharded(spark, sf_dir))


@query(f"WITH {_ORDERED} SELECT coalesce(split, 'all') AS split, coalesce(client, -1) AS client, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS positives FROM s GROUP BY ROLLUP (s.split, s.client)")
def split_rollup(spark, sf_dir):
    return sharding.split_rollup(sharded(spark, sf_dir)).fillna({"split": "all", "client": -1})


@query(f"WITH {_ORDERED} SELECT split, count(DISTINCT label) = 2 AS both_classes, count(DISTINCT client) AS clients FROM s GROUP BY split")
def split_coverage(spark, sf_dir):
    rows = sharding.split_counts(sharded(spark, sf_dir))
    return rows.groupBy("split").agg(((F.sum("negatives") > 0) & (F.sum("positives") > 0)).alias("both_classes"), F.count_distinct("client").alias("clients"))


@query("""WITH h AS (SELECT user_id % 50 AS grp, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, strftime(ts, '%Y-%m-%d') AS day FROM events)
SELECT grp, day, count(*) AS n FROM h GROUP BY grp, day HAVING count(DISTINCT label) = 1""")
def single_class_partitions(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("user_id") % 50).alias("grp"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "label")
    return rows.groupBy("grp", "day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("k")).where("k = 1").drop("k")


@query(f"""WITH {_ORDERED} SELECT format('C1_L{{:03d}}', client + 1) AS client_id, min(pos) AS "start", max(pos) + 1 AS "end", count(*) AS n_rows FROM s GROUP BY client""")
def client_ranges(spark, sf_dir):
    return sharding.client_metadata(sharded(spark, sf_dir), 1).select("client_id", "start", "end", "n_rows")


# --- features --------------------------------------------------------------------------------


@query(
    "WITH r AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_orderkey, l_linenumber FROM lineitem)\n"
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(CAST(median({f}) AS DOUBLE), 8) AS median, round(avg({f}), 8) AS mean, round(stddev_pop({f}), 8) AS scale FROM r"
        for f in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    )
)
def numeric_fit(spark, sf_dir):
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    fit = features.fit_numeric(table(spark, sf_dir, "lineitem").select(*names, F.col("l_orderkey").alias("pos")), names)
    rows = spark.createDataFrame([(f, *v) for f, v in fit.kept.items()], "feature string, median double, mean double, scale double")
    return _rounded(rows, "median", "mean", "scale", digits=8)


@query(f"""WITH {_ORDERED}, x AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(value AS FLOAT)::DOUBLE END AS f FROM s),
m AS (SELECT median(f) AS med FROM x WHERE split = 'train'),
p AS (SELECT avg(coalesce(f, med)) AS mean, stddev_pop(coalesce(f, med)) AS scale FROM x, m WHERE split = 'train')
SELECT event_id, split, round((coalesce(f, med) - mean) / scale, 4) AS z FROM x, m, p""")
def zscore_train_only(spark, sf_dir):
    rows = sharded(spark, sf_dir, "value").withColumn("f", F.when(F.col("event_id") % 11 != 0, F.col("value").cast("float").cast("double")))
    fit = features.fit_numeric(rows.where("split = 'train'"), ["f"])
    return rows.select("event_id", "split", F.round(features.scaled("f", *fit.kept["f"]).cast("double"), 4).alias("z"))


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS f FROM events), m AS (SELECT median(f) AS med FROM x)
SELECT event_id, round(coalesce(f, med), 6) AS f FROM x, m""")
def median_impute(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("f"))
    return rows.select("event_id", F.round(F.coalesce("f", F.lit(features.median(rows, "f")).cast("double")), 6).alias("f"))


@query("SELECT o_orderpriority AS category, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS place FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def category_fit(spark, sf_dir):
    kept, _ = features.fit_categories(table(spark, sf_dir, "orders"), ["o_orderpriority"])
    return spark.createDataFrame([(c, i) for i, c in enumerate(kept["o_orderpriority"])], "category string, place long")


@query("""WITH c AS (SELECT list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS cats FROM orders)
SELECT o_orderkey, array_to_string(list_transform(cats, lambda x: CASE WHEN x = o_orderpriority THEN '1' ELSE '0' END), '') AS bits FROM orders, c""")
def one_hot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    kept, _ = features.fit_categories(rows, ["o_orderpriority"])
    bits = F.transform(S.one_hot("o_orderpriority", kept["o_orderpriority"]), lambda x: x.cast("int").cast("string"))
    return rows.select("o_orderkey", F.array_join(bits, "").alias("bits"))


@query(f"""WITH {_ORDERED}, w AS (SELECT client, split, local_pos, row_number() OVER q - 1 AS rn, count(*) OVER f AS k, max(label) OVER f AS window_label FROM s
WINDOW q AS (PARTITION BY client, split ORDER BY local_pos), f AS (PARTITION BY client, split ORDER BY local_pos ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING))
SELECT client, split, local_pos AS start_pos, rn // 8 AS window_no, CAST(window_label AS INTEGER) AS window_label FROM w WHERE k = 32 AND rn % 8 = 0""")
def sliding_window_labels(spark, sf_dir):
    return features.window_labels(sharded(spark, sf_dir), width=32, stride=8)


@query(f"""WITH {_ORDERED}, w AS (SELECT client, split, local_pos, row_number() OVER q - 1 AS rn, count(*) OVER f AS k, sum(value) OVER f AS total, max(label) OVER f AS window_label FROM s
WINDOW q AS (PARTITION BY client, split ORDER BY local_pos), f AS (PARTITION BY client, split ORDER BY local_pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
SELECT client, split, local_pos AS start_pos, round(total, 4) AS total, CAST(window_label AS INTEGER) AS window_label FROM w WHERE k = 16 AND rn % 16 = 0""")
def sliding_window_features(spark, sf_dir):
    rows = sharded(spark, sf_dir, "value").withColumn("features", F.array("value", F.lit(1.0)))
    windows = features.window_features(rows, width=16, stride=16)
    total = F.aggregate(F.element_at("window", 1), F.lit(0.0), lambda a, x: a + x)
    return windows.select("client", "split", "start_pos", F.round(total, 4).alias("total"), "window_label")


@query(f"WITH {_ORDERED} SELECT client, split, event_id FROM (SELECT *, row_number() OVER (PARTITION BY client, split ORDER BY local_pos) AS k FROM s) WHERE k <= 20")
def head_cap_per_client(spark, sf_dir):
    return features.capped(sharded(spark, sf_dir), 20).select("client", "split", "event_id")


@query(f"""WITH {_ORDERED} SELECT count(*) FILTER (WHERE label = 0) AS negatives, count(*) FILTER (WHERE label = 1) AS positives,
CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) / count(*) FILTER (WHERE label = 1) AS positive_weight FROM s WHERE split = 'train'""")
def class_weight(spark, sf_dir):
    return features.class_weight(sharded(spark, sf_dir).where("split = 'train'"))


# --- groups ----------------------------------------------------------------------------------

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DESCRIBED = "d AS (SELECT l_suppkey % 12 AS client, " + ", ".join(f"avg({f}) AS mean_{f}, stddev_pop({f}) AS std_{f}" for f in _FEATURES) + " FROM lineitem GROUP BY 1)"
_DESCRIPTORS = [f"{k}_{f}" for k in ("mean", "std") for f in _FEATURES]


def _described(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % CLIENTS).alias("client"), *_FEATURES)
    return grouping.descriptors(rows, _FEATURES)


@query(f"WITH {_DESCRIBED} SELECT client, {', '.join(f'round({c}, 6) AS {c}' for c in _DESCRIPTORS)} FROM d")
def client_descriptors(spark, sf_dir):
    return _rounded(_described(spark, sf_dir), *_DESCRIPTORS)


@query(f"WITH {_DESCRIBED} SELECT client, {', '.join(f'round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 4) AS {c}' for c in _DESCRIPTORS)} FROM d")
def descriptor_zscore(spark, sf_dir):
    return _rounded(grouping.standardised(_described(spark, sf_dir), _DESCRIPTORS), *_DESCRIPTORS, digits=4)


@query()
def ward_groups(spark, sf_dir):
    """Three groups of the twelve shards; tested against brute force."""
    return grouping.group_shards(_described(spark, sf_dir), _DESCRIPTORS, 3, ["H1", "H2", "H3"])


@query("""WITH g AS (SELECT 'C1_L' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 3, '0') AS client_id, n_nationkey + 1 AS k, 5 - n_regionkey AS raw FROM nation),
f AS (SELECT raw, row_number() OVER (ORDER BY min(k)) AS r FROM g GROUP BY raw) SELECT client_id, ['H1', 'H2', 'H3', 'H4', 'H5'][r] AS subcluster_id FROM g JOIN f USING (raw)""")
def deterministic_relabel(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(S.client_name(F.lit(1), F.col("n_nationkey") + 1).alias("client_id"), (5 - F.col("n_regionkey")).alias("raw"))
    return grouping.relabelled(rows, ["H1", "H2", "H3", "H4", "H5"]).select("client_id", "subcluster_id")


# --- scores ----------------------------------------------------------------------------------

_COUNTS = """SELECT count(*) FILTER (WHERE label <> 1 AND p < 0.05) AS tn, count(*) FILTER (WHERE label <> 1 AND p >= 0.05) AS fp,
count(*) FILTER (WHERE label = 1 AND p < 0.05) AS fn, count(*) FILTER (WHERE label = 1 AND p >= 0.05) AS tp, count(*) AS support FROM sc"""


@query(f"WITH {_SCORED} {_COUNTS}")
def confusion_at_threshold(spark, sf_dir):
    return scoring.confusion(scored(spark, sf_dir), 0.05)


@query(f"""WITH {_SCORED}, c AS ({_COUNTS}) SELECT tn, fp, fn, tp, support, coalesce(CAST(tn + tp AS DOUBLE) / nullif(support, 0), 0) AS accuracy,
coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS "precision", coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1, coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0) AS fpr FROM c""")
def binary_metrics(spark, sf_dir):
    return scoring.binary_metrics(scored(spark, sf_dir), 0.05)


@query(f"""WITH {_SCORED}, q AS (SELECT label, greatest(least(p, 1 - CAST(0.000001 AS DOUBLE)), CAST(0.000001 AS DOUBLE)) AS c FROM sc)
SELECT round(avg(CASE WHEN label = 1 THEN -ln(c) ELSE -ln(1 - c) END), 8) AS log_loss FROM q""")
def log_loss(spark, sf_dir):
    return _rounded(scoring.mean_log_loss(scored(spark, sf_dir)), "log_loss", digits=8)


_STEPS = f"""{_SCORED}, g AS (SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM sc GROUP BY p),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g WINDOW w AS (ORDER BY p DESC))"""


@query(f"""WITH {_STEPS} SELECT round(CAST(1.0 AS DOUBLE) - sum(pos * (fp - neg + CAST(0.5 AS DOUBLE) * neg)) / (CAST(max(np) AS DOUBLE) * max(nn)), 8) AS auroc,
round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(np), 8) AS average_precision, CAST(max(np) AS BIGINT) AS n_positive, CAST(max(nn) AS BIGINT) AS n_negative FROM t""")
def auroc_avg_precision(spark, sf_dir):
    return _rounded(scoring.ranking_metrics(scored(spark, sf_dir)), "auroc", "average_precision", digits=8)


@query(f"""WITH {_STEPS}, f AS (SELECT p, CAST(2 * tp AS DOUBLE) / (tp + fp + np) AS f1 FROM t), m AS (SELECT max(f1) AS best FROM f)
SELECT p AS threshold, f1 FROM f, m WHERE best - f1 <= CAST(0.00000001 AS DOUBLE) + CAST(0.00001 AS DOUBLE) * best ORDER BY abs(p - 0.5), p DESC LIMIT 1""")
def best_f1_threshold(spark, sf_dir):
    return scoring.best_threshold(scored(spark, sf_dir))


_MONTHS = "r AS (SELECT l_returnflag AS experiment_id, CAST(month(l_shipdate) AS INTEGER) AS round, round(avg(CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END), 2) AS val_f1 FROM lineitem GROUP BY 1, 2)"


def _months(spark, sf_dir):
    hit = F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("experiment_id"), F.month("l_shipdate").alias("round")).agg(F.round(F.avg(hit), 2).alias("val_f1"))


@query(f"WITH {_MONTHS} SELECT experiment_id, round, val_f1 FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY val_f1 DESC, round DESC) AS k FROM r) WHERE k = 1")
def best_round(spark, sf_dir):
    return scoring.best_round(_months(spark, sf_dir))


@query(f"""WITH {_SCORED}, e AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM sc),
g AS (SELECT p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM e WHERE split = 'validation' GROUP BY p),
t AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np FROM g WINDOW w AS (ORDER BY p DESC)),
f AS (SELECT p, CAST(2 * tp AS DOUBLE) / (tp + fp + np) AS f1 FROM t), m AS (SELECT max(f1) AS best FROM f),
x AS (SELECT p AS tuned FROM f, m WHERE best - f1 <= CAST(0.00000001 AS DOUBLE) + CAST(0.00001 AS DOUBLE) * best ORDER BY abs(p - 0.5), p DESC LIMIT 1),
y AS (SELECT split, label, p, 'default' AS rule, CAST(0.5 AS DOUBLE) AS threshold FROM e UNION ALL SELECT split, label, p, 'tuned', tuned FROM e, x WHERE split <> 'train')
SELECT split, rule, threshold, count(*) FILTER (WHERE label = 1 AND p >= threshold) AS tp, count(*) FILTER (WHERE label = 0 AND p >= threshold) AS fp, count(*) AS support FROM y GROUP BY ALL""")
def evaluate_round(spark, sf_dir):
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    return scoring.evaluate(scored(spark, sf_dir).withColumn("split", split)).select("split", "rule", "threshold", "tp", "fp", "support")


_RATES = {
    "accuracy": "CAST(tn + tp AS DOUBLE) / n", "precision": "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)", "recall": "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)",
    "f1": "coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0)", "auroc": "auroc", "pr_auc": "pr_auc", "fpr": "coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0)",
}
_ROUND_ROW = ", ".join(
    [f"round(max(CASE WHEN split = 'train' AND rule = 'default' THEN {_RATES[c]} END), 6) AS train_{c}" for c in ("accuracy", "f1")]
    + [f"round(max(CASE WHEN split = '{s}' AND rule = 'tuned' THEN {v} END), 6) AS {s}_{c}" for s in ("validation", "test") for c, v in ({"loss": "loss"} | _RATES).items()]
    + [f"round(max(CASE WHEN split = '{s}' AND rule = 'default' THEN {v} END), 6) AS {s}_{c}_default_threshold" for s in ("validation", "test") for c, v in _RATES.items()]
)


@query(f"""WITH {_SCORED}, x AS (SELECT ['train', 'validation', 'test'][doc_id % 3 + 1] AS split, label, p FROM sc),
g AS (SELECT split, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM x GROUP BY split, p),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY split) AS np, sum(neg) OVER (PARTITION BY split) AS nn FROM g WINDOW w AS (PARTITION BY split ORDER BY p DESC)),
k AS (SELECT split, CAST(1.0 AS DOUBLE) - sum(pos * (fp - neg + CAST(0.5 AS DOUBLE) * neg)) / (CAST(max(np) AS DOUBLE) * max(nn)) AS auroc, sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(np) AS pr_auc FROM c GROUP BY split),
q AS (SELECT split, label, greatest(least(p, 1 - CAST(0.000001 AS DOUBLE)), CAST(0.000001 AS DOUBLE)) AS c FROM x),
e AS (SELECT split, avg(CASE WHEN label = 1 THEN -ln(c) ELSE -ln(1 - c) END) AS loss FROM q GROUP BY split),
b AS (SELECT p, CAST(2 * tp AS DOUBLE) / (tp + fp + np) AS f1 FROM c WHERE split = 'validation'), m AS (SELECT max(f1) AS best FROM b),
t AS (SELECT p AS tuned FROM b, m WHERE best - f1 <= CAST(0.00000001 AS DOUBLE) + CAST(0.00001 AS DOUBLE) * best ORDER BY abs(p - 0.5), p DESC LIMIT 1),
r AS (SELECT x.*, rule, CASE WHEN rule = 'tuned' THEN tuned ELSE 0.5 END AS threshold FROM x, t, (VALUES ('default'), ('tuned')) v(rule)),
f AS (SELECT split, rule, count(*) AS n, count(*) FILTER (WHERE label <> 1 AND p < threshold) AS tn, count(*) FILTER (WHERE label <> 1 AND p >= threshold) AS fp,
  count(*) FILTER (WHERE label = 1 AND p < threshold) AS fn, count(*) FILTER (WHERE label = 1 AND p >= threshold) AS tp FROM r GROUP BY split, rule)
SELECT {_ROUND_ROW}, round(max(tuned), 6) AS threshold_used FROM f JOIN k USING (split) JOIN e USING (split), t""")
def round_metrics_row(spark, sf_dir):
    """A round's row: losses, rates and ranking metrics of all splits, at the tuned threshold and at 0.5."""
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))
    row = scoring.round_row(scoring.evaluate(scored(spark, sf_dir).withColumn("split", split)))
    return _rounded(row, *row.columns)


@query(f"""WITH {_SCORED}, x AS (SELECT doc_id % 5 AS part, label, p FROM sc),
g AS (SELECT part, p, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM x GROUP BY part, p),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY part) AS np, sum(neg) OVER (PARTITION BY part) AS nn FROM g WINDOW w AS (PARTITION BY part ORDER BY p DESC))
SELECT part, round(CAST(1.0 AS DOUBLE) - sum(pos * (fp - neg + CAST(0.5 AS DOUBLE) * neg)) / (CAST(max(np) AS DOUBLE) * max(nn)), 8) AS auroc,
round(sum(pos * CAST(tp AS DOUBLE) / (tp + fp)) / max(np), 8) AS average_precision, CAST(max(np) AS BIGINT) AS n_positive, CAST(max(nn) AS BIGINT) AS n_negative FROM c GROUP BY part""")
def ranking_by_group(spark, sf_dir):
    """Ranking metrics of five groups of documents in one pass."""
    rows = scored(spark, sf_dir).withColumn("part", F.col("doc_id") % 5)
    return _rounded(scoring.ranking_metrics(rows, by=("part",)), "auroc", "average_precision", digits=8)


# --- model state -----------------------------------------------------------------------------

_TWO = """u AS (SELECT subcluster_id, key, idx, sum(value * n) / sum(n) AS value, sum(n) AS n FROM w GROUP BY ALL),
k AS (SELECT key, idx, round(sum(value * n) / sum(n), 6) AS value, CAST(sum(n) AS BIGINT) AS n FROM u GROUP BY ALL)"""


@query(f"WITH {_STATES}, w AS (SELECT * FROM st), {_TWO} SELECT 1 AS cluster_id, * FROM k")
def weighted_mean_two_level(spark, sf_dir):
    return _rounded(state.elements(state.two_level_vector_mean(vectors(spark, sf_dir)), "cluster_id", "n"), "value")


@query(f"WITH {_STATES}, w AS (SELECT * FROM st WHERE NOT regexp_matches(lower(key), 'bn|batchnorm|running_mean|running_var|num_batches_tracked')), {_TWO} SELECT 1 AS cluster_id, * FROM k")
def bn_excluded_mean(spark, sf_dir):
    return _rounded(state.elements(state.two_level_vector_mean(vectors(spark, sf_dir), batch_norm=False), "cluster_id", "n"), "value")


@query(f"""WITH {_STATES}, w AS (SELECT * FROM st), {_TWO}, own AS (SELECT key, idx, value FROM st WHERE contributor = 3)
SELECT k.key, k.idx, round(CASE WHEN k.key LIKE '%bn%' THEN coalesce(own.value, k.value) ELSE k.value END, 6) AS value FROM k LEFT JOIN own ON k.key = own.key AND k.idx = own.idx""")
def state_merge(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _rounded(state.merge_state(state.elements(state.two_level_vector_mean(rows)), state.elements(rows.where("contributor = 3"))), "value")


@query(f"""WITH {_STATES}, w AS (SELECT * FROM st), {_TWO}, ref AS (SELECT key, idx, value FROM st WHERE contributor = 0)
SELECT ref.key, ref.idx, round(CASE WHEN ref.key LIKE '%bn%' THEN ref.value ELSE k.value END, 6) AS value FROM ref JOIN k ON ref.key = k.key AND ref.idx = k.idx""")
def state_replace(spark, sf_dir):
    """The mean of all contributors takes the place of one state, but for its batch normalisation."""
    rows = vectors(spark, sf_dir)
    return _rounded(state.replace_state(state.elements(rows.where("contributor = 0")), state.elements(state.two_level_vector_mean(rows))), "value")


@query(f"""WITH {_STATES}, d AS (SELECT key, idx, sum(value) AS s FROM st GROUP BY ALL), n AS (SELECT count(DISTINCT contributor) AS n FROM st), c AS (SELECT key, idx, value FROM st WHERE contributor = 0)
SELECT c.key, c.idx, round(c.value + coalesce(d.s, 0) / n.n, 6) AS value FROM c CROSS JOIN n LEFT JOIN d ON c.key = d.key AND c.idx = d.idx""")
def scaffold_update(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return _rounded(state.server_control(state.elements(rows.where("contributor = 0")), state.elements(state.vector_sum(rows)), rows.select("contributor").distinct().count()), "value")


@query(f"WITH {_STATES}, r AS (SELECT key, idx, value AS b FROM st WHERE contributor = 0) SELECT contributor, round(0.005 * sum(power(value - b, 2)), 8) AS penalty FROM st JOIN r ON st.key = r.key AND st.idx = r.idx GROUP BY contributor")
def proximal_penalty(spark, sf_dir):
    rows = states(spark, sf_dir)
    return _rounded(state.proximal_penalty(rows, rows.where("contributor = 0"), 0.01, by=("contributor",)), "penalty", digits=8)


@query(f"WITH {_STATES} SELECT contributor, round(sqrt(sum(power(value, 2))), 6) AS l2_norm FROM st GROUP BY contributor")
def state_l2_norm(spark, sf_dir):
    return _rounded(state.l2_norm(states(spark, sf_dir), by=("contributor",)), "l2_norm")


@query(f"WITH {_STATES} SELECT contributor, 4 * count(*) AS all_bytes, 4 * count(*) FILTER (WHERE NOT regexp_matches(lower(key), 'bn|running_mean')) AS shared_bytes FROM st GROUP BY contributor")
def parameter_bytes(spark, sf_dir):
    return state.state_bytes(states(spark, sf_dir), by=("contributor",))


# --- reports ---------------------------------------------------------------------------------


@query("""WITH r AS (SELECT 'run_' || CAST(label AS VARCHAR) AS run, CAST(4 * max(len(embedding)) AS BIGINT) AS state_bytes, CAST(CASE WHEN label % 2 = 0 THEN 4 * max(len(embedding)) ELSE 0 END AS BIGINT) AS control_bytes,
count(DISTINCT vec_id) AS clients, count(DISTINCT vec_id % 5) AS subclusters, 10 + CAST(label AS BIGINT) AS rounds FROM embeddings GROUP BY label)
SELECT *, (state_bytes + control_bytes) * 2 * (clients + subclusters) AS bytes_per_round, (state_bytes + control_bytes) * 2 * (clients + subclusters) * rounds AS total_bytes,
CAST((state_bytes + control_bytes) * 2 * (clients + subclusters) * rounds AS DOUBLE) / 1048576 AS total_mib FROM r""")
def communication_cost(spark, sf_dir):
    """One run per label of the vectors, with its vectors as clients; runs of even labels send control variates too."""
    size = 4 * F.max(F.size("embedding")).cast("long")
    runs = table(spark, sf_dir, "embeddings").groupBy("label").agg(size.alias("state_bytes"), F.count_distinct("vec_id").alias("clients"), F.count_distinct(F.col("vec_id") % 5).alias("subclusters"))
    runs = runs.select(F.concat(F.lit("run_"), F.col("label").cast("string")).alias("run"), "state_bytes", F.when(F.col("label") % 2 == 0, F.col("state_bytes")).otherwise(0).alias("control_bytes"), "clients", "subclusters", (10 + F.col("label").cast("long")).alias("rounds"))
    return reports.communication_cost(runs)


_ARTIFACTS = "a AS (SELECT DISTINCT event_type AS experiment_id, user_id % 4 AS seed, CASE WHEN event_type = 'error' AND user_id % 4 = 1 THEN 'failed' WHEN event_type IN ('click', 'purchase') OR user_id % 4 < 2 THEN 'metrics' ELSE 'log' END AS kind FROM events)"


@query(f"""WITH {_ARTIFACTS}, g AS (SELECT DISTINCT event_type AS experiment_id, s.seed FROM events, (SELECT unnest(range(0, 5)) AS seed) s),
x AS (SELECT g.experiment_id, g.seed, max(CAST(kind = 'failed' AS INTEGER)) AS f, max(CAST(kind = 'metrics' AS INTEGER)) AS m FROM g LEFT JOIN a USING (experiment_id, seed) GROUP BY ALL),
y AS (SELECT *, CASE WHEN f = 1 THEN 'FAILED' WHEN m = 1 THEN 'COMPLETE' WHEN f IS NOT NULL THEN 'PARTIAL' ELSE 'MISSING' END AS state FROM x)
SELECT experiment_id, count(*) AS n_seeds, count(*) FILTER (WHERE state = 'COMPLETE') AS n_complete,
CASE WHEN count(*) FILTER (WHERE state = 'COMPLETE') = count(*) THEN 'COMPLETE' WHEN count(*) FILTER (WHERE state = 'COMPLETE') > 0 THEN 'PARTIAL' WHEN count(*) FILTER (WHERE state IN ('FAILED', 'PARTIAL')) > 0 THEN 'FAILED' ELSE 'MISSING' END AS status FROM y GROUP BY experiment_id""")
def seed_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    kind = F.expr("CASE WHEN event_type = 'error' AND user_id % 4 = 1 THEN 'failed' WHEN event_type IN ('click', 'purchase') OR user_id % 4 < 2 THEN 'metrics' ELSE 'log' END")
    artifacts = rows.select(F.col("event_type").alias("experiment_id"), (F.col("user_id") % 4).alias("seed"), kind.alias("kind"))
    grid = reports.seed_grid(rows.select(F.col("event_type").alias("experiment_id")), spark.range(5).withColumnRenamed("id", "seed"))
    return reports.experiment_status(reports.seed_states(grid, artifacts))


@query("""WITH r AS (SELECT event_type AS experiment_id, user_id % 3 AS seed, avg(value) AS m FROM events GROUP BY ALL)
SELECT experiment_id, 'm' AS metric, count(m) AS n, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM r GROUP BY experiment_id""")
def mean_std_over_seeds(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("experiment_id"), (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("m"))
    return _rounded(reports.mean_std(runs, ["m"]).drop("display"), "mean", "std")


_FLAGS = "m AS (SELECT l_returnflag AS experiment_id, avg(l_discount) AS f1, CAST(count(*) AS DOUBLE) AS total FROM lineitem GROUP BY 1)"


@query(f"""WITH {_FLAGS} SELECT p.control_id, p.treatment_id, round(c.f1, 6) AS control_f1, round(t.f1, 6) AS treatment_f1, round(t.f1 - c.f1, 6) AS delta_f1, c.total AS control_total, t.total AS treatment_total, t.total - c.total AS delta_total
FROM (VALUES ('A', 'N'), ('A', 'R'), ('N', 'Z')) p(control_id, treatment_id) LEFT JOIN m c ON c.experiment_id = p.control_id LEFT JOIN m t ON t.experiment_id = p.treatment_id""")
def treatment_control_delta(spark, sf_dir):
    metrics = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("experiment_id")).agg(F.avg("l_discount").alias("f1"), F.count(F.lit(1)).cast("double").alias("total"))
    pairs = spark.createDataFrame([("A", "N"), ("A", "R"), ("N", "Z")], "control_id string, treatment_id string")
    return _rounded(reports.deltas(metrics, pairs, ["f1", "total"]), "control_f1", "treatment_f1", "delta_f1")


@query("""SELECT l_linestatus AS cluster_id, round(max(q) FILTER (WHERE l_returnflag = 'A'), 6) AS "A", round(max(q) FILTER (WHERE l_returnflag = 'N'), 6) AS "N", round(max(q) FILTER (WHERE l_returnflag = 'R'), 6) AS "R"
FROM (SELECT l_linestatus, l_returnflag, avg(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_linestatus""")
def metric_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("cluster_id"), F.col("l_returnflag").alias("method")).agg(F.avg("l_quantity").alias("q"))
    return _rounded(reports.metric_pivot(rows, "q", ["A", "N", "R"]), "A", "N", "R")


@query("""WITH r AS (SELECT l_returnflag AS f, l_suppkey % 3 AS seed, avg(l_discount) AS m FROM lineitem GROUP BY ALL), a AS (SELECT f, stddev_pop(m) AS s, count(*) AS n FROM r GROUP BY f)
SELECT c.f AS control_id, t.f AS treatment_id, round(CASE WHEN c.n > 1 AND t.n > 1 THEN sqrt(c.s * c.s + t.s * t.s) END, 8) AS error FROM a c, a t WHERE c.f = 'A' AND t.f <> 'A'""")
def delta_error(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), (F.col("l_suppkey") % 3).alias("seed")).agg(F.avg("l_discount").alias("m"))
    stats = runs.groupBy("f").agg(F.stddev_pop("m").alias("s"), F.count(F.lit(1)).alias("n"))
    control = F.broadcast(stats.where("f = 'A'").select(F.col("f").alias("control_id"), F.col("s").alias("cs"), F.col("n").alias("cn")))
    both = stats.where("f <> 'A'").crossJoin(control)  # one control row
    return both.select("control_id", F.col("f").alias("treatment_id"), F.round(reports.delta_error(F.col("cs"), F.col("s"), F.col("cn"), F.col("n")), 8).alias("error"))


@query("""WITH r AS (SELECT event_type AS experiment_id, CAST(dayofyear(ts) AS INTEGER) AS round, user_id % 3 AS seed, avg(value) AS m FROM events GROUP BY ALL)
SELECT experiment_id, round, count(m) AS n, round(avg(m), 6) AS mean, round(stddev_pop(m), 6) AS std FROM r GROUP BY experiment_id, round""")
def convergence_band(spark, sf_dir):
    rounds = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("experiment_id"), F.dayofyear("ts").alias("round"), (F.col("user_id") % 3).alias("seed")).agg(F.avg("value").alias("m"))
    return _rounded(reports.curve_band(rounds, "m"), "mean", "std")


@query("""WITH r AS (SELECT CAST(dayofyear(ts) AS INTEGER) AS round, event_type AS subcluster_id, user_id, avg(value) AS loss FROM events GROUP BY ALL), s AS (SELECT round, subcluster_id, avg(loss) AS loss FROM r GROUP BY ALL)
SELECT round, round(avg(loss), 6) AS loss FROM s GROUP BY round""")
def unweighted_two_level_loss(spark, sf_dir):
    losses = table(spark, sf_dir, "events").groupBy(F.dayofyear("ts").alias("round"), F.col("event_type").alias("subcluster_id"), "user_id").agg(F.avg("value").alias("loss"))
    return _rounded(reports.two_level_loss(losses), "loss")


_AXES = {"status": "o_orderstatus", "priority": "o_orderpriority", "year": "year(o_orderdate)"}


@query("""WITH s AS (SELECT status, row_number() OVER (ORDER BY status <> 'O', status) AS a FROM (SELECT DISTINCT o_orderstatus AS status FROM orders)),
p AS (SELECT priority, row_number() OVER (ORDER BY priority) AS b FROM (SELECT DISTINCT o_orderpriority AS priority FROM orders)), y AS (SELECT year, row_number() OVER (ORDER BY year) AS c FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders)),
g AS (SELECT status, priority, year, row_number() OVER (ORDER BY a, b, c) AS trial_no FROM s, p, y)
SELECT 'trial_' || lpad(CAST(trial_no AS VARCHAR), 4, '0') AS trial_id, CAST(trial_no AS INTEGER) AS trial_no, status, priority, year FROM g""")
def trial_grid(spark, sf_dir):
    """Every combination of the values that three columns of the orders have."""
    sets = table(spark, sf_dir, "orders").agg(*(F.sort_array(F.collect_set(F.expr(e))).alias(a) for a, e in _AXES.items())).first()
    return reports.trial_grid(spark, sets.asDict(), {"status": ["O"]})


_TRIALS = "t AS (SELECT event_id AS trial_no, round(value, 0) AS val_f1, round(value / 7, 0) AS test_f1, CAST(user_id % 5 AS DOUBLE) AS test_fpr, CAST(user_id % 3 AS DOUBLE) AS seconds, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM events)"


@query(f"WITH {_TRIALS} SELECT * FROM t WHERE status = 'COMPLETE' ORDER BY val_f1 DESC, test_f1 DESC, test_fpr, seconds, trial_no LIMIT 1")
def best_trial(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("trial_no"), F.round("value", 0).alias("val_f1"), F.round(F.col("value") / 7, 0).alias("test_f1"), (F.col("user_id") % 5).cast("double").alias("test_fpr"), (F.col("user_id") % 3).cast("double").alias("seconds"), F.when(F.col("event_type") == "error", "FAILED").otherwise("COMPLETE").alias("status"))
    return reports.best_trial(rows)


_REGISTRY = """m AS (SELECT n_nationkey AS experiment_id, n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey <> 3),
r AS (SELECT n_nationkey AS experiment_id, CASE WHEN n_nationkey = 7 THEN 'x' ELSE n_name END AS name, CASE WHEN n_nationkey IN (7, 9) THEN NULL ELSE n_regionkey END AS region FROM nation WHERE n_nationkey <> 5)"""


def _registry(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("experiment_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    key = F.col("experiment_id")
    other = rows.where(key != 5).withColumns({"name": F.when(key == 7, "x").otherwise(F.col("name")), "region": F.when(~key.isin(7, 9), F.col("region"))})
    return rows.where(key != 3), other


@query(f"""WITH {_REGISTRY}, j AS (SELECT coalesce(m.experiment_id, r.experiment_id) AS experiment_id, CASE WHEN m.experiment_id IS NULL THEN 'missing in matrix' WHEN r.experiment_id IS NULL THEN 'missing in registry'
WHEN m.name IS DISTINCT FROM r.name AND m.region IS DISTINCT FROM r.region THEN 'differs: name,region' WHEN m.name IS DISTINCT FROM r.name THEN 'differs: name' WHEN m.region IS DISTINCT FROM r.region THEN 'differs: region' END AS problem
FROM m FULL JOIN r ON m.experiment_id = r.experiment_id) SELECT * FROM j WHERE problem IS NOT NULL""")
def registry_crosscheck(spark, sf_dir):
    return reports.registry_differences(*_registry(spark, sf_dir), ["name", "region"])


@query(f"WITH {_REGISTRY} SELECT experiment_id, 'left' AS side FROM m WHERE experiment_id NOT IN (SELECT experiment_id FROM r) UNION ALL SELECT experiment_id, 'right' FROM r WHERE experiment_id NOT IN (SELECT experiment_id FROM m)")
def missing_both_ways(spark, sf_dir):
    return grouping.key_differences(*_registry(spark, sf_dir), "experiment_id")


@query("""WITH r AS (SELECT user_id % 3 AS cluster_id, event_id AS round_id, sha256(CAST(event_id AS VARCHAR)) AS new_hash FROM events),
p AS (SELECT *, lag(new_hash) OVER (PARTITION BY cluster_id ORDER BY round_id) AS expected FROM r), q AS (SELECT *, CASE WHEN round_id % 101 = 0 THEN 'x' ELSE expected END AS previous_hash FROM p)
SELECT cluster_id, round_id FROM q WHERE previous_hash IS DISTINCT FROM expected""")
def ledger_chain_verify(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("cluster_id"), F.col("event_id").alias("round_id"), F.sha2(F.col("event_id").cast("string"), 256).alias("new_hash"))
    before = ledger.with_previous(rows, new="new_hash", span=1000)
    rows = before.withColumn("previous_hash", F.when(F.col("round_id") % 101 == 0, "x").otherwise(F.col("expected"))).drop("expected")
    return ledger.broken_links(rows, new="new_hash", previous="previous_hash", span=1000).select("cluster_id", "round_id")


@query("""SELECT user_id % 3 AS cluster_id, count(*) AS n_records, round(avg((epoch_us(ts + to_milliseconds(CAST(event_id % 7 AS INTEGER))) - epoch_us(ts)) / 1000.0), 6) AS mean_latency_ms FROM events GROUP BY 1""")
def ledger_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("cluster_id"), F.col("ts").cast("timestamp").alias("timestamp_start"), F.expr("cast(ts as timestamp) + make_dt_interval(0, 0, 0, (event_id % 7) / 1000.0)").alias("timestamp_end"))
    return _rounded(ledger.latency(rows), "mean_latency_ms")


# --- training rounds (no SQL; tests train clients by hand and check gradients by differences) -----


#: Rows of a shard of the training queries, about: shards grow in number with the input, not in size.
SHARD_ROWS = 20_000


def _examples(spark, sf_dir, *, windows: bool) -> DataFrame:
    """events in twelve shards, or as many as SHARD_ROWS ask for, and three sub-clusters as training examples: windows of 16 rows, or single rows."""
    rows = events(spark, sf_dir).select("ts", "event_id", "label", "value", "user_id")
    rows = sharding.shard_and_split(rows, ["ts", "event_id"], max(CLIENTS, -(-rows.count() // SHARD_ROWS)))
    rows = rows.withColumns({"a": F.col("value").cast("double"), "b": (F.col("user_id") % 24).cast("double")})
    fit = features.fit_numeric(rows.where("split = 'train'"), ["a", "b"])
    rows = features.transform(rows, fit, {})
    if windows:
        rows = features.window_features(rows, width=16, stride=8).select("client", "split", F.col("start_pos").alias("example"), F.col("window").alias("features"), F.col("window_label").alias("label"))
    else:
        rows = rows.select("client", "split", F.col("local_pos").alias("example"), F.array("features").alias("features"), "label")
        rows = rows.withColumn("features", F.transform(F.element_at("features", 1), lambda x: F.array(x)))
    return rows.withColumn("subcluster_id", F.format_string("H%d", F.col("client") % 3 + 1))


def _rounds(spark, sf_dir, network, windows: bool, **options) -> DataFrame:
    """Two rounds, so that what clients keep from the first one takes part in the second."""
    from plumbline.operators import federated

    rounds, _, _ = federated.run_rounds(_examples(spark, sf_dir, windows=windows), federated.Training(network, **options), 2)
    return spark.createDataFrame([(r["round"], k, None if v is None else float(v)) for r in rounds for k, v in r.items() if k != "round"], "round int, metric string, value double")


@query()
def train_round_cnn(spark, sf_dir):
    from plumbline.operators.networks import Network

    return _rounds(spark, sf_dir, Network("cnn", 2, 16), True, method="scaffold", rate=0.01)


@query()
def train_round_mlp(spark, sf_dir):
    from plumbline.operators.networks import Network

    return _rounds(spark, sf_dir, Network("mlp", 2), False, method="fedprox", rate=0.001, adam=True)


@query()
def train_round_tcn(spark, sf_dir):
    from plumbline.operators.networks import Network

    return _rounds(spark, sf_dir, Network("tcn", 2, 16, blocks=(8, 8, 8), head=8), True, method="fedbn", rate=0.01)


from plumbline.plans import catalog_io  # noqa: E402, F401  registers its queries here
