"""Column profiles of text tables: missing cells, numeric columns, histograms, schema roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scalars import is_missing, is_number


def profile_columns(table: DataFrame, columns: list[str] | None = None, *, by=()) -> DataFrame:
    """One row per column (and group): column, n_rows, n_missing, n_present, is_numeric.

    A column is numeric if it has a value and every value is a number. All columns are counted in
    one pass side by side; the rows are then turned upright.
    """
    columns = columns or [c for c in table.columns if c not in by]
    text = {c: F.col(f"`{c}`").cast("string") for c in columns}
    sums = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(is_missing(t)).alias("n_missing"), F.count_if(~is_missing(t) & ~is_number(t)).alias("n_other")).alias(f"s{i}") for i, (c, t) in enumerate(text.items())]
    one = table.groupBy(*by).agg(*sums)
    rows = one.select(*by, F.inline(F.array(*[f"s{i}" for i in range(len(sums))])))
    present = F.col("n_rows") - F.col("n_missing")
    return rows.select(*by, "column", "n_rows", "n_missing", present.alias("n_present"), ((present > 0) & (F.col("n_other") == 0)).alias("is_numeric"))


def histogram(table: DataFrame, column: str, *, by=()) -> DataFrame:
    """value, n of a column as text."""
    return table.groupBy(*by, F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(table: DataFrame, column: str, *, by=()) -> DataFrame:
    """The histogram as one map per group, sorted by value; for label-like columns."""
    rows = histogram(table, column, by=by)
    return rows.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("counts"))


def schema_rollup(columns: DataFrame) -> DataFrame:
    """(file, column) rows as column, n_files, in_all, of all files: union of the columns, and intersection where in_all."""
    files = columns.select("file").distinct().agg(F.count(F.lit(1)).alias("files"))
    per = columns.groupBy("column").agg(F.count_distinct("file").alias("n_files"))
    return per.crossJoin(F.broadcast(files)).select("column", "n_files", (F.col("n_files") == F.col("files")).alias("in_all"))


def incidence(columns: DataFrame) -> DataFrame:
    """Every column with every file: file, column, present. The grid is of schemas, not of rows."""
    grid = columns.select("file").distinct().crossJoin(columns.select("column").distinct())
    return grid.join(columns.select("file", "column").distinct().withColumn("present", F.lit(True)), ["file", "column"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def column_classes(columns: list[str], *, labels: list[str], times: list[str], leakage: list[str]) -> dict[str, list[str]]:
    """The profiler's classes by names without regard to case, the sorted columns to leave out, and the rest in header order."""
    low = lambda names: {n.lower() for n in names}
    found = {n: [c for c in columns if c.lower() in low(v)] for n, v in (("label", labels), ("time", times), ("leakage", leakage))}
    out = sorted({c for v in found.values() for c in v})
    return found | {"excluded": out, "retained": [c for c in columns if c not in out]}


def profile_report(table: DataFrame, *, label: str, file: str = "file") -> dict:
    """Profile by file, label histogram and blockers of a table of text rows; small results only reach the driver."""
    columns = [c for c in table.columns if c != file]
    rows = profile_columns(table, columns, by=(file,)).collect()
    labels = histogram(table, label, by=(file,)).collect()
    numeric = {f: {r.column: r.is_numeric for r in rows if r[file] == f} for f in sorted({r[file] for r in rows})}
    blockers = []
    if len({tuple(sorted(v.items())) for v in numeric.values()}) > 1:
        blockers.append("files differ in which columns are numeric")
    return {"columns": [r.asDict() for r in rows], "labels": {f: {r.value: r.n for r in labels if r[file] == f} for f in numeric}, "blockers": blockers}
