"""Registered queries that go through sources, sinks and the scalar functions: what is written and read again equals the tables it came from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.functions.hashing import canonical_sha256_column, membership_sha256
from plumbline.operators import features, ledger, reports, sharding
from plumbline.plans.catalog import _ORDERED, events, query, sharded, table
from plumbline.sources import csv_tables, experiments, harmonise, sinks
from plumbline.sources.contract import Contract
from plumbline.sources.files import workspace

# --- scalar functions ------------------------------------------------------------------------

_LOGIT = "e AS (SELECT event_id, CAST(value AS DOUBLE) / 50 - 4 AS x, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events)"
_PLUS = "greatest({0}, 0.0) + ln(1 + exp(-abs({0})))"


@query(f"""WITH {_LOGIT} SELECT event_id, round(least(greatest(1 / (1 + exp(-least(greatest(x, -30), 30))), 1e-6), 1 - 1e-6), 6) AS p, round({_PLUS.format("x")}, 6) AS plus,
round(3.0 * y * ({_PLUS.format("(-x)")}) + (1 - y) * ({_PLUS.format("x")}), 6) AS loss, round((1 - y) / (1 + exp(-x)) - 3.0 * y * (1 - 1 / (1 + exp(-x))), 6) AS gradient FROM e""")
def logit_functions(spark, sf_dir):
    """Sigmoid, softplus, weighted loss of a logit and its derivative."""
    rows = events(spark, sf_dir).select("event_id", (F.col("value").cast("double") / 50 - 4).alias("x"), F.col("label").alias("y"))
    found = {"p": S.sigmoid("x"), "plus": S.softplus("x"), "loss": S.logit_loss("x", "y", 3.0), "gradient": S.logit_gradient("x", "y", 3.0)}
    return rows.select("event_id", *(F.round(v, 6).alias(n) for n, v in found.items()))


@query("""WITH r AS (SELECT CAST(value AS DOUBLE) / 100 AS a, CAST(user_id % 24 AS DOUBLE) / 24 AS b, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM events),
g AS (SELECT *, (1 - y) / (1 + exp(-(0.3 * a - 0.2 * b + 0.1))) - 2.0 * y * (1 - 1 / (1 + exp(-(0.3 * a - 0.2 * b + 0.1)))) AS d FROM r)
SELECT unnest(['a', 'b', 'bias']) AS key, unnest([round(0.3 - 0.05 * avg(d * a), 8), round(-0.2 - 0.05 * avg(d * b), 8), round(0.1 - 0.05 * avg(d), 8)]) AS value FROM g""")
def gradient_step(spark, sf_dir):
    """One step of gradient descent of a linear model over all rows, as one aggregate."""
    rows = events(spark, sf_dir).select((F.col("value").cast("double") / 100).alias("a"), (F.col("user_id") % 24 / 24).cast("double").alias("b"), F.col("label").alias("y"))
    return features.linear_step(rows, {"a": 0.3, "b": -0.2}, 0.1, label="y", rate=0.05, positive_weight=2.0).select("key", F.round("value", 8).alias("value"))


@query("""SELECT n_nationkey, lower(n_name) AS source, printf('C%d_L%03d', n_regionkey, n_nationkey) AS client, CAST(n_nationkey AS INTEGER) AS number, printf('C%d_R%03d', n_regionkey, n_nationkey) AS round,
printf('MC%d_HEAD', n_regionkey) AS head, CASE WHEN n_nationkey % 4 = 0 THEN 'NOT AVAILABLE' ELSE printf('%.4f +- %.4f', n_nationkey / 8.0, CASE WHEN n_nationkey % 3 = 0 THEN 0.0 ELSE n_regionkey / 4.0 END) END AS display,
CASE n_nationkey % 3 WHEN 0 THEN NULL WHEN 1 THEN n_nationkey / 2.0 ELSE NULL END AS cell, CASE n_nationkey % 3 WHEN 0 THEN 'sha256:' || sha256(n_name) WHEN 1 THEN 'sha256:' || sha256('y') ELSE 'sha256:' || sha256(n_name) END AS digest,
CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey END AS tn, CASE WHEN n_nationkey % 2 = 0 THEN CAST(4 AS BIGINT) END AS tp FROM nation""")
def name_functions(spark, sf_dir):
    """Names, display strings, metric cells, digests and confusion matrices in text."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    rows = table(spark, sf_dir, "nation").withColumns(
        {
            "path": F.concat(F.lit("data/Train_Test_IoT_"), "n_name", F.lit(".csv")),
            "cell_text": F.when(n % 3 == 0, " ").when(n % 3 == 1, F.concat(F.lit(" "), (n / 2).cast("string"))).otherwise("single class"),
            "hash_text": F.when(n % 3 == 0, F.sha2("n_name", 256)).when(n % 3 == 1, F.concat(F.lit("sha256:"), F.sha2(F.lit("y"), 256))).otherwise("none"),
            "matrix": F.when(n % 2 == 0, F.format_string("[[%d, 2], [3, 4]]", n)).otherwise("[[1, 2]]"),
        }
    )
    counts = S.confusion_counts("matrix")
    return rows.select(
        "n_nationkey", S.source_name("path").alias("source"), S.client_name(r, n).alias("client"), S.client_number(S.client_name(r, n)).alias("number"), S.round_name(r, n).alias("round"), S.head_name(r).alias("head"),
        S.mean_std_text(F.when(n % 4 != 0, n / 8), F.when(n % 3 != 0, r / 4)).alias("display"), S.retyped("cell_text").alias("cell"), S.sha256_or("hash_text", "n_name").alias("digest"), counts["tn"].alias("tn"), counts["tp"].alias("tp"),
    )


@query("""SELECT o_orderkey, '20' || strftime(CAST(o_orderdate AS DATE), '%y-%m-%d') AS day, CAST(epoch_us(CAST(o_orderdate AS TIMESTAMP)) - 7200000000 AS BIGINT) AS micros, o_orderkey % 7 <> 0 AS known FROM orders""")
def time_functions(spark, sf_dir):
    """Order keys from dates in words, and times with an offset, from text."""
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    stamp = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    odd = F.when(F.col("o_orderkey") % 7 == 0, "yesterday").otherwise(stamp)
    return rows.select("o_orderkey", S.day_key(F.date_format("o_orderdate", "d-MMM-yy")).alias("day"), F.unix_micros(S.timestamp_of(stamp)).alias("micros"), S.timestamp_of(odd).isNotNull().alias("known"))


@query("""SELECT c_custkey, 'sha256:' || sha256('{"balance":' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || ',"key":' || CAST(c_custkey AS VARCHAR) || ',"nation":[' || CAST(c_nationkey AS VARCHAR) || ',null]}') AS digest FROM customer""")
def canonical_hashes(spark, sf_dir):
    """Digests that do not hang on the order of keys or on spaces."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.format_string('{ "nation": [%d, null], "key": %d,  "balance": %d}', "c_nationkey", "c_custkey", F.floor("c_acctbal").cast("long")).alias("text"))
    return rows.select("c_custkey", canonical_sha256_column("text").alias("digest"))


@query("""SELECT n_regionkey, sha256('[' || string_agg('{"client_id": "C' || n_regionkey || '_L' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || '", "n": ' || n_nationkey || '}', ', ' ORDER BY n_nationkey) || ']') AS digest FROM nation GROUP BY n_regionkey""")
def membership_hashes(spark, sf_dir):
    """The digest of each sub-cluster's client list."""

    def digest(group: pd.DataFrame) -> pd.DataFrame:
        clients = [{"client_id": c, "n": int(n)} for c, n in zip(group["client_id"], group["n"], strict=True)]
        return pd.DataFrame({"n_regionkey": group["region"].iloc[:1], "digest": [membership_sha256(clients)]})

    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), S.client_name("n_regionkey", "n_nationkey").alias("client_id"), F.col("n_nationkey").alias("n"))
    return rows.groupBy("region").applyInPandas(lambda g: digest(g.sort_values("n")), "n_regionkey long, digest string")


# --- sources and sinks -----------------------------------------------------------------------

_KIND = "CASE WHEN user_id % 13 = 0 THEN 'nan' ELSE 'k' || CAST(user_id % 5 AS VARCHAR) END"


def _event_files(spark, sf_dir) -> list[str]:
    """events as two CSV files of several parts, in the order of their ids, with missing cells."""
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 10 == 0, " ").otherwise(F.col("value").cast("string")).alias("value"), F.when(F.col("user_id") % 13 == 0, "nan").otherwise(F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string"))).alias("kind"), F.col("label").cast("string").alias("label"))
    paths = []
    for part in (0, 1):
        paths.append(workspace(spark, f"events-{part}"))
        sinks.write_csv_parts(rows.where(F.col("event_id") % 2 == part).orderBy("event_id"), paths[-1])
    return paths


def _ragged_lines(spark, sf_dir) -> str:
    """events as lines of CSV in the order of their ids: props in quotes, and one cell too many or too few in some."""
    path = workspace(spark, "events-lines")
    cells = F.concat_ws(",", F.col("event_id"), F.concat(F.lit('"'), F.replace(F.concat(F.lit('say "a, b", '), "event_type"), F.lit('"'), F.lit('""')), F.lit('"')), F.col("user_id"))
    line = F.when(F.col("event_id") % 577 == 99, F.concat(cells, F.lit(","))).when(F.col("event_id") % 811 == 5, F.col("event_id").cast("string")).otherwise(cells)
    # parts begin at many places in the order, so that numbers have to be carried over them; each has its header
    rows = table(spark, sf_dir, "events").select("event_id", line.alias("line")).orderBy("event_id").drop("event_id")
    rows.mapInArrow(sinks.with_first_line("event_id,said,user_id"), "line string").write.text(path)
    return path


_RAGGED = """WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS row_ord,
CASE WHEN event_id % 577 = 99 THEN 4 WHEN event_id % 811 = 5 THEN 1 ELSE 3 END AS n_cells FROM events)"""


@query(f"{_RAGGED} SELECT row_ord, CAST(n_cells AS INTEGER) AS n_cells, 3::INTEGER AS n_columns FROM r WHERE n_cells <> 3")
def csv_ragged_rows(spark, sf_dir):
    """All rows of a CSV file of many splits with another number of cells than the header, by their number."""
    lines = csv_tables.numbered_lines(spark, csv_tables.parts_of([_ragged_lines(spark, sf_dir)]))
    return csv_tables.ragged_rows(lines).select("row_ord", "n_cells", "n_columns")


@query(f"{_RAGGED} SELECT min(row_ord) AS row_ord, CAST(min_by(n_cells, row_ord) AS INTEGER) AS n_cells FROM r WHERE n_cells <> 3")
def csv_first_ragged(spark, sf_dir):
    """The first of them, by one aggregate."""
    lines = csv_tables.numbered_lines(spark, csv_tables.parts_of([_ragged_lines(spark, sf_dir)]))
    return csv_tables.first_ragged(lines).select("row_ord", "n_cells")


@query(f"""{_RAGGED} SELECT row_ord, CAST(event_id AS VARCHAR) AS event_id, CASE WHEN n_cells <> 1 THEN 'say "a, b", ' || event_type END AS said FROM r""")
def csv_numbered_rows(spark, sf_dir):
    """The rows of that file, padded, in the order of their numbers."""
    rows = csv_tables.scan(spark, [_ragged_lines(spark, sf_dir)], ragged="pad")
    return rows.select("row_ord", "event_id", "said")


@query(f"""WITH r AS (SELECT event_id % 2 AS file_ord, unnest([CAST(event_id AS VARCHAR), CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(value AS VARCHAR) END, CASE WHEN user_id % 13 = 0 THEN NULL ELSE {_KIND} END, '0']) AS cell, unnest(['event_id', 'value', 'kind', 'label']) AS "column" FROM events)
SELECT CAST(file_ord AS INTEGER) AS file_ord, "column", count(*) AS n_rows, count(*) - count(cell) AS n_missing, count(cell) AS n_present, "column" <> 'kind' AS is_numeric FROM r GROUP BY ALL""")
def csv_inspection(spark, sf_dir):
    """Two CSV files written, then profiled by file and column."""
    paths = _event_files(spark, sf_dir)
    found = csv_tables.inspect(spark, paths, Contract(1, "events", paths[0], "label", excluded=("label",)))
    return spark.createDataFrame([tuple(r) for r in found["profile"]], "file_ord int, column string, n_rows long, n_missing long, n_present long, is_numeric boolean")


@query(f"""SELECT event_id % 2 AS file_ord, event_id, round(CASE WHEN event_id % 10 <> 0 THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END, 4) AS value, {_KIND} AS kind, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label FROM events""")
def csv_training_table(spark, sf_dir):
    """The contract's rows of two CSV files, typed: numbers, text and labels."""
    paths = _event_files(spark, sf_dir)
    rows = csv_tables.scan(spark, paths)
    contract = Contract(1, "events", paths[0], "label", order=("event_id",), excluded=("label", "event_id"))
    found = csv_tables.inspect(spark, paths, contract)
    numeric, text = csv_tables.feature_columns(found, contract, [c for c in rows.columns if c not in (csv_tables.FILE, csv_tables.ROW)])
    return rows.select(F.col(csv_tables.FILE).cast("long").alias("file_ord"), F.col("event_id").cast("long").alias("event_id"), *(F.round(S.feature_number(c), 4).alias(c) for c in numeric), *(S.trimmed(c).alias(c) for c in text), S.binary_label("label").cast("int").alias("label"))


_DAILY = "SELECT CAST(dayofyear(ts) AS INTEGER) AS round, count(*) AS n, round(avg(value), 6) AS loss, CASE WHEN dayofyear(ts) % 3 = 0 THEN NULL ELSE round(max(value), 6) END AS auroc FROM events GROUP BY 1, dayofyear(ts) % 3"


@query(_DAILY)
def round_metrics_csv(spark, sf_dir):
    """A row per round written as CSV with cells that are not available, and read again as numbers."""
    rows = table(spark, sf_dir, "events").groupBy(F.dayofyear("ts").alias("round")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("loss"), F.round(F.max("value"), 6).alias("auroc"))
    text = rows.withColumn("auroc", F.when(F.col("round") % 3 == 0, "NOT AVAILABLE").otherwise(F.col("auroc").cast("string")))
    path = workspace(spark, "rounds")
    sinks.write_csv(text, path)
    found = experiments.read_metrics(spark, path, ["loss", "auroc"])
    return found.select(F.col("round").cast("int").alias("round"), F.col("n").cast("long").alias("n"), "loss", "auroc")


@query(f"""WITH {_ORDERED} SELECT printf('C2_L%03d', client + 1) AS client_id, split, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n_rows, count(*) FILTER (WHERE label = 0) AS zero, count(*) FILTER (WHERE label = 1) AS one FROM s GROUP BY client, split""")
def client_metadata_json(spark, sf_dir):
    """The nested metadata of each shard written as JSON, read again and laid flat."""
    path = workspace(spark, "clients")
    sinks.write_json(sharding.client_metadata(sharded(spark, sf_dir), 2), path)
    found = spark.read.json(path).select("client_id", F.inline("splits"))
    return found.select("client_id", "split", "start", "end", "n_rows", F.coalesce(F.col("label_counts")["0"], F.lit(0)).alias("zero"), F.coalesce(F.col("label_counts")["1"], F.lit(0)).alias("one"))


@query("""SELECT 'E' || (quality % 2) AS experiment_id, CAST(doc_id % 3 AS INTEGER) AS seed, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, sum(toxic) AS positives, round(sum(CAST(CAST(doc_id % 1000 AS DOUBLE) / 1000 AS FLOAT)::DOUBLE), 3) AS total FROM labels GROUP BY ALL""")
def prediction_sink(spark, sf_dir):
    """Scores written in single precision by experiment, seed and split, and summed from there."""
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("E"), (F.col("quality") % 2).cast("string")).alias("experiment_id"), (F.col("doc_id") % 3).cast("int").alias("seed"), F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"), F.lit(0).alias("client"), (F.col("doc_id") % 1000 / 1000).alias("p"), F.col("toxic").alias("label"))
    path = workspace(spark, "predictions")
    sinks.write_predictions(rows, path)
    found = spark.read.parquet(path)
    return found.groupBy("experiment_id", "seed", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.round(F.sum(F.col("probability").cast("double")), 3).alias("total"))


@query("""SELECT event_type AS experiment_id, CAST(user_id % 3 AS INTEGER) AS seed, arg_max(CASE WHEN value > 50 THEN 'COMPLETE' ELSE 'FAILED' END, event_id) AS status, arg_max(CAST(event_id AS VARCHAR), event_id) AS detail FROM events GROUP BY ALL""")
def status_markers(spark, sf_dir):
    """Status rows appended in two writes; the latest of each run counts."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("experiment_id"), (F.col("user_id") % 3).cast("int").alias("seed"), F.when(F.col("value") > 50, "COMPLETE").otherwise("FAILED").alias("status"), F.col("event_id").cast("string").alias("detail"), F.col("event_id").alias("at"))
    path = workspace(spark, "status")
    for part in (0, 1):
        sinks.write_status(rows.where(F.col("at") % 2 == part), path)
    return sinks.read_status(spark, path)


_RECORDS = """r AS (SELECT n_regionkey % 3 + 1 AS c, n_nationkey + 1 AS r, n_name AS m FROM nation)"""


@query(f"""WITH {_RECORDS} SELECT CAST(r AS INTEGER) AS round_id, CAST(c AS INTEGER) AS cluster_id, 'MC' || c || '_HEAD' AS cluster_head_id, 'sha256:' || sha256(m) AS new_main_model_hash,
CASE WHEN lag(m) OVER w IS NOT NULL THEN 'sha256:' || sha256(lag(m) OVER w) END AS previous_main_model_hash, CAST(r * 10 AS BIGINT) AS effective_sample_count, 0.5::DOUBLE AS seconds FROM r WINDOW w AS (PARTITION BY c ORDER BY r)""")
def ledger_round_trip(spark, sf_dir):
    """Checked records of three heads appended to a ledger, each by its own head, and read again with their latency."""
    rows = table(spark, sf_dir, "nation").select((F.col("n_regionkey") % 3 + 1).cast("int").alias("cluster_id"), (F.col("n_nationkey") + 1).cast("int").alias("round_id"), F.concat(F.lit("sha256:"), F.sha2("n_name", 256)).alias("new_main_model_hash"))
    rows = rows.withColumns({"previous_main_model_hash": ledger.previous_hash("new_main_model_hash"), "cluster_head_id": S.head_name("cluster_id")})
    text = {"model_version": "v1", "clustering_method": "ward", "fl_method": "fedavg", "aggregation_rule": "weighted_mean", "timestamp_start": "2024-01-01T00:00:00Z", "timestamp_end": "2024-01-01T00:00:00.500Z"}
    digest = F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256))
    rows = rows.withColumns({n: F.lit(v) for n, v in text.items()} | {"clustering_configuration_hash": digest, "subcluster_membership_hash": digest, "subcluster_count": F.lit(2), "participant_count": F.lit(3), "effective_sample_count": (F.col("round_id") * 10).cast("long"), "submitter_identity": F.col("cluster_head_id")})
    path = workspace(spark, "ledger")
    for cluster in (1, 2, 3):
        ledger.append(rows.where(F.col("cluster_id") == cluster), path, role=ledger.HEAD_ROLE, identity=f"MC{cluster}_HEAD")
    found = ledger.read(spark, path)
    spent = (F.unix_micros(S.timestamp_of("timestamp_end")) - F.unix_micros(S.timestamp_of("timestamp_start"))) / 1e6
    return found.select("round_id", "cluster_id", "cluster_head_id", "new_main_model_hash", "previous_main_model_hash", "effective_sample_count", spent.alias("seconds"))


@query("""SELECT source, count(*) AS n, count(*) FILTER (WHERE a = '') AS no_a, count(*) FILTER (WHERE b = '') AS no_b FROM (SELECT 'customer' AS source, CAST(c_acctbal AS VARCHAR) AS a, '' AS b FROM customer UNION ALL SELECT 'supplier', '', CAST(s_acctbal AS VARCHAR) FROM supplier) GROUP BY source""")
def union_table_sink(spark, sf_dir):
    """Tables with different columns put together, written and read again."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    parts = {"Customer": c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").alias("label")), "Supplier": s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("b"), F.col("s_nationkey").alias("label"))}
    path = workspace(spark, "union")
    sinks.write_table(harmonise.harmonised(parts, shared=["name"], last=["label"]), path, by=("source",))
    found = spark.read.parquet(path)
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == "").alias("no_a"), F.count_if(F.col("b") == "").alias("no_b"))


@query("SELECT n_name AS experiment_id, CAST(n_regionkey AS VARCHAR) AS cluster_id FROM nation")
def experiment_matrix(spark, sf_dir):
    """A matrix of experiments written as CSV and read by its rules."""
    rows = table(spark, sf_dir, "nation").select(F.concat(F.lit(" "), "n_name").alias("experiment_id"), F.col("n_regionkey").alias("cluster_id"), *(F.lit("x").alias(c) for c in experiments.MATRIX_COLUMNS[2:]))
    path = workspace(spark, "matrix")
    sinks.write_csv(rows, path)
    return experiments.read_matrix(spark, path).select("experiment_id", "cluster_id")


# --- reports ---------------------------------------------------------------------------------

_GRID = {"returned": "l_returnflag", "state": "l_linestatus", "mode": "cast(round(l_discount * 100) as int)", "line": "cast(l_linenumber as int)", "year": "year(l_shipdate)"}
_AXIS = {"returned": "l_returnflag", "state": "l_linestatus", "mode": "CAST(round(l_discount * 100) AS INTEGER)", "line": "CAST(l_linenumber AS INTEGER)", "year": "CAST(year(l_shipdate) AS INTEGER)"}
_GRID_SQL = ", ".join(f"x_{a} AS (SELECT {a}, row_number() OVER (ORDER BY {a}{' <> 3' if a == 'line' else ''}, {a}) AS r_{a} FROM (SELECT DISTINCT {e} AS {a} FROM lineitem))" for a, e in _AXIS.items()) + f""",
g AS (SELECT *, row_number() OVER (ORDER BY {", ".join(f"r_{a}" for a in _AXIS)}) AS trial_no FROM {", ".join(f"x_{a}" for a in _AXIS)})"""


def _grid(spark, sf_dir):
    """The grid of the values that the columns have; each has a few."""
    sets = table(spark, sf_dir, "lineitem").agg(*(F.sort_array(F.collect_set(F.expr(e))).alias(a) for a, e in _GRID.items())).first()
    return reports.trial_grid(spark, sets.asDict(), {"line": [3]})


@query(f"""WITH {_GRID_SQL} SELECT 'trial_' || lpad(CAST(trial_no AS VARCHAR), 4, '0') AS trial_id, CAST(trial_no AS INTEGER) AS trial_no, {", ".join(_AXIS)} FROM g""")
def trial_grid_full(spark, sf_dir):
    """All trials of a grid whose five axes have the values of five columns of the line items, preferred values first."""
    return _grid(spark, sf_dir)


_RESULTS = "r AS (SELECT 'trial_' || lpad(CAST(o_orderkey % 9000 + 1 AS VARCHAR), 4, '0') AS trial_id, min(CASE WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'COMPLETE' END) AS status FROM orders GROUP BY 1)"


def _results(spark, sf_dir):
    """Every order is an attempt at a trial, some of them outside the grid; a complete one counts."""
    rows = table(spark, sf_dir, "orders")
    tried = rows.select(S.trial_name((F.col("o_orderkey") % 9000 + 1).cast("int")).alias("trial_id"), F.when(F.col("o_orderkey") % 3 == 0, "FAILED").otherwise("COMPLETE").alias("status"))
    return tried.groupBy("trial_id").agg(F.min("status").alias("status"))


_NAMED = "n AS (SELECT trial_no, 'trial_' || lpad(CAST(trial_no AS VARCHAR), 4, '0') AS trial_id FROM g)"


@query(f"WITH {_GRID_SQL}, {_NAMED}, {_RESULTS} SELECT (SELECT count(*) FROM n) AS n_trials, count(*) AS n_attempted, count(*) FILTER (WHERE status = 'COMPLETE') AS n_complete FROM r WHERE trial_id IN (SELECT trial_id FROM n)")
def trial_counts(spark, sf_dir):
    return reports.trial_counts(_grid(spark, sf_dir), _results(spark, sf_dir))


@query(f"WITH {_GRID_SQL}, {_NAMED}, {_RESULTS} SELECT trial_id FROM n WHERE trial_no BETWEEN 1001 AND 3000 AND trial_id NOT IN (SELECT trial_id FROM r WHERE status = 'COMPLETE')")
def open_trials(spark, sf_dir):
    """The trials of a stretch of the grid that have no complete result."""
    return reports.open_trials(_grid(spark, sf_dir), _results(spark, sf_dir), start=1000, most=2000).select("trial_id")


@query("WITH f AS (SELECT user_id AS experiment_id, CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS tier, event_id FROM events) SELECT * FROM f QUALIFY tier = min(tier) OVER (PARTITION BY experiment_id)")
def first_tier(spark, sf_dir):
    """The artefacts of the first tier in which an experiment has any."""
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("experiment_id"), F.expr("CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END").alias("tier"), "event_id")
    return reports.first_tier(found)


@query("""SELECT 'c' || c_custkey AS experiment_id, round(c_acctbal, 2) AS f1, NULL::BIGINT AS rounds, c_mktsegment AS segment FROM customer UNION ALL SELECT 's' || s_suppkey, NULL, s_nationkey, NULL FROM supplier""")
def summary_table(spark, sf_dir):
    """Runs with different columns in one table, the preferred columns first."""
    a = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("experiment_id"), F.round("c_acctbal", 2).alias("f1"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("experiment_id"), F.col("s_nationkey").cast("long").alias("rounds"))
    return reports.summary_table([a, b], ["experiment_id", "f1"])


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END AS tn, CASE WHEN c_custkey % 4 <> 0 THEN c_nationkey END AS fp, CASE WHEN c_custkey % 4 <> 0 THEN 3 END AS fn, CASE WHEN c_custkey % 4 <> 0 THEN 4 END AS tp, CASE WHEN c_custkey % 4 <> 0 THEN 'ok' ELSE 'missing_confusion_matrix' END AS status FROM customer""")
def confusion_report(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.format_string("[[%d, %d], [3, 4]]", "c_custkey", "c_nationkey")).otherwise("").alias("matrix"))
    return reports.confusion_report(rows, "matrix").drop("matrix")
