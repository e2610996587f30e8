"""CSV files as tables of text with file and row numbers, checked against a contract.

Files are read as lines, so that large ones are split over tasks and all files are one scan however
many there are. What a header says of its file (names, and so the place of each column) comes
from the driver, which reads the first line of each file, and meets the lines by a broadcast join.
Lines are numbered by a prefix scan: one pass counts the lines of each split, and a line's number
is the lines of the splits before it and its place in its own. A cell may not hold a line break.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import scalars as S
from plumbline.operators.profile import profile_columns
from plumbline.sources.contract import Contract, ContractError, profile_files, training_files
from plumbline.sources.files import first_line, part_files

#: Columns that every scan adds: the file's place in the list, and the row's place in the file, from 0.
FILE, ROW = "file_ord", "row_ord"
_OPTIONS = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "maxColumns": "20480", "mode": "PERMISSIVE"}
#: A cell in quotes, with the comma or line start before it.
_QUOTED = r'(^|,)"(?:[^"]|"")*"(?=,|$)'


@dataclass(frozen=True)
class Part:
    """One file on disk: the place of the path that it belongs to, its own place in there, its names, whether a mark comes first."""

    file: int
    part: int
    location: str
    names: tuple[str, ...]
    mark: bool


def header_of(path: str) -> tuple[list[str], bool]:
    """The names in the first line of a file, and whether a byte-order mark comes first, which is taken off."""
    line = first_line(path)
    if not line:
        raise ContractError(f"{path} is empty")
    mark = line.startswith(b"\xef\xbb\xbf")
    return [S.header_name(c) for c in next(csv.reader([line.decode("utf-8-sig")]))], mark


def parts_of(paths: list[str]) -> list[Part]:
    """All files of the paths, a folder standing for its part files in order of their names; these must have one header."""
    found = []
    for number, path in enumerate(paths):
        for place, location in enumerate(part_files(path)):
            names, mark = header_of(location)
            if place and tuple(names) != found[-1].names:
                raise ContractError(f"{path}: part files have different headers")
            found.append(Part(number, place, location, tuple(names), mark))
        if not found or found[-1].file != number:
            raise ContractError(f"{path} is empty")
    return found


def _location(path: Column) -> Column:
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def numbered_lines(spark: SparkSession, parts: list[Part]) -> DataFrame:
    """The lines of all files below their headers: FILE, ROW, __part, __line (from 1, the header's), __cells (how many there should be), value.

    One job counts the lines of each split; the driver holds a row for each of these, 128 MB of
    text by default. Numbers hold for the files as they are; should splits differ when the lines
    are read, the query raises.
    """
    known = [(p.location, p.file, p.part, len(p.names)) for p in parts]
    files = spark.createDataFrame(known, f"__location string, {FILE} int, __part int, __cells int").withColumn("__location", _location(F.col("__location")))
    lines = spark.read.text([p.location for p in parts]).select(
        "value", _location(F.col("_metadata.file_path")).alias("__location"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id")
    )
    lines = lines.join(F.broadcast(files), "__location").drop("__location")
    split = [FILE, "__part", "__block"]
    counted = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    in_part = Window.partitionBy(FILE, "__part").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy(FILE).orderBy("__part", "__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumns({"__lines": F.coalesce(F.sum("__n").over(in_part), F.lit(0)), "__rows": F.coalesce(F.sum(F.col("__n") - (F.col("__block") == 0).cast("int")).over(in_file), F.lit(0))})
    starts = spark.createDataFrame(starts.collect(), starts.schema)
    rows = lines.join(F.broadcast(starts), split)
    place = F.col("__id") - F.col("__first")
    place = F.when(place.between(0, F.col("__n") - 1), place).otherwise(F.raise_error(F.lit("the files' splits are not those that were counted")).cast("long"))
    head = (F.col("__block") == 0).cast("int")
    rows = rows.select(FILE, "__part", "__cells", "value", (F.col("__lines") + place + 1).alias("__line"), (F.col("__rows") + place - head).alias(ROW))
    return rows.where("__line > 1")


def cells_in(line: str = "value") -> Column:
    """How many cells a line has; an empty line has none."""
    bare = F.regexp_replace(line, _QUOTED, "$1")
    return F.when(F.col(line) == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1).cast("int")


def ragged_rows(lines: DataFrame) -> DataFrame:
    """Of ``numbered_lines``, those with another number of cells than their header: FILE, __part, ROW, line, n_cells, n_columns."""
    return lines.select(FILE, "__part", ROW, F.col("__line").alias("line"), cells_in().alias("n_cells"), F.col("__cells").alias("n_columns")).where("n_cells <> n_columns")


def first_ragged(lines: DataFrame) -> DataFrame:
    """The first ragged row of each file, by one aggregate over all: FILE, part, line, row_ord, n_cells, n_columns."""
    columns = ["__part", "line", ROW, "n_cells", "n_columns"]
    return ragged_rows(lines).groupBy(FILE).agg(F.min(F.struct(*columns)).alias("r")).select(FILE, F.col("r.__part").alias("part"), *(f"r.{c}" for c in columns[1:]))


def _refuse_ragged(paths: list[str], parts: list[Part], lines: DataFrame) -> None:
    bad = first_ragged(lines).orderBy(FILE).first()
    if bad:
        location = next(p.location for p in parts if (p.file, p.part) == (bad[FILE], bad.part))
        where = f"{paths[bad[FILE]]}" + (f" ({location.rsplit('/', 1)[-1]})" if bad.part else "")
        raise ContractError(f"{where}: row {bad.line} has another number of cells ({bad.n_cells}) than the header ({bad.n_columns})")


def _table(spark: SparkSession, parts: list[Part], lines: DataFrame) -> DataFrame:
    """Lines as columns of text by name; a column that a file lacks is null there."""
    names = list(dict.fromkeys(n for p in parts for n in p.names))
    width = max(len(p.names) for p in parts)
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), _OPTIONS)
    layouts = {p.file: p.names for p in parts}
    if len(set(layouts.values())) == 1:
        columns = {n: F.col(f"__row.c{i}") for i, n in enumerate(names)}
    else:
        places = [(f, [own.index(n) if n in own else None for n in names]) for f, own in layouts.items()]
        lines = lines.join(F.broadcast(spark.createDataFrame(places, f"{FILE} int, __places array<int>")), FILE)
        every = F.array(*(F.col(f"__row.c{i}") for i in range(width)))
        columns = {n: F.get(every, F.get("__places", F.lit(i))) for i, n in enumerate(names)}
    return lines.withColumn("__row", cells).select(*(c.alias(n) for n, c in columns.items()), FILE, ROW)


def scan(spark: SparkSession, paths: list[str], *, ragged: str = "reject") -> DataFrame:
    """All columns of all files as text, by name, with FILE and ROW; a column that a file lacks is null there.

    Each file is read with its own header. A row with another number of cells, an empty line
    among them, is refused with the file's name and the line's number (``ragged="reject"``), or
    filled and cut, empty lines being passed over (``"pad"``). The number of jobs does not depend
    on the number of files.
    """
    parts = parts_of(paths)
    lines = numbered_lines(spark, parts)
    if ragged == "reject":
        _refuse_ragged(paths, parts, lines)
    else:
        lines = lines.where("value <> ''")
    return _table(spark, parts, lines)


def inspect(spark: SparkSession, paths: list[str], contract: Contract, *, consistent: bool = True, require_label: bool = True) -> dict:
    """What the files hold: column profile and label counts by file, columns of all and of each, and what blocks training.

    Raises for a missing label column, ragged rows, labels that cannot be mapped, a single class
    over all files, and, if ``consistent``, different headers. Headers are judged before any row is read.
    """
    parts = parts_of(paths)
    headers = {p.file: list(p.names) for p in parts}
    for i, names in headers.items():
        if require_label and contract.label not in names:
            raise ContractError(f"{paths[i]}: the label {contract.label} is not among its columns ({', '.join(names)})")
    one = len({tuple(h) for h in headers.values()}) == 1
    if consistent and not one:
        raise ContractError("files have different headers")
    lines = numbered_lines(spark, parts)
    _refuse_ragged(paths, parts, lines)
    table = _table(spark, parts, lines)
    columns = [c for c in table.columns if c not in (FILE, ROW)]
    profile = [r for r in profile_columns(table, columns, by=(FILE,)).collect() if r.column in headers[r[FILE]]]
    labels = table.groupBy(FILE, S.trimmed(contract.label).alias("raw")).agg(F.count(F.lit(1)).alias("n"), F.first(S.binary_label(contract.label)).alias("label")).collect() if require_label else []
    unknown = sorted({r.raw for r in labels if r.label is None})
    if unknown:
        raise ContractError(f"labels {sorted({r.raw for r in labels})} include values that are neither 0 nor 1: {unknown}")
    if require_label and {r.label for r in labels} != {0, 1}:
        raise ContractError("all labels are of one class")
    sets = [set(h) for h in headers.values()]
    return {
        "profile": profile,
        "labels": {c: sum(r.n for r in labels if r.label == c) for c in (0, 1)},
        "union": sorted(set.union(*sets)),
        "intersection": sorted(set.intersection(*sets)),
        "consistent": one,
        "blockers": [] if one else ["files have different schemas; training needs one combined table"],
        "issues": [f"{paths[p.file]}: byte-order mark" for p in parts if p.mark and not p.part],
    }


def feature_columns(found: dict, contract: Contract, header: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and text features: header order less what the contract leaves out, typed by all files, which must agree."""
    kept = [c for c in header if c not in (*contract.excluded, *contract.excluded_if_present)]
    kinds = {c: {r.is_numeric for r in found["profile"] if r.column == c} for c in kept}
    mixed = [c for c, k in kinds.items() if len(k) > 1]
    if mixed:
        raise ContractError(f"files disagree on whether these columns are numeric: {', '.join(mixed)}")
    return [c for c in kept if kinds[c] == {True}], [c for c in kept if kinds[c] == {False}]


def training_table(spark: SparkSession, contract: Contract) -> tuple[DataFrame, list[str], list[str]]:
    """The contract's rows, typed: FILE, ROW, label, order columns as text, numeric features as doubles, text features as text."""
    paths = training_files(contract)
    found = inspect(spark, paths, contract)
    table = scan(spark, paths)
    numeric, text = feature_columns(found, contract, [c for c in table.columns if c not in (FILE, ROW)])
    if not numeric and not text:
        raise ContractError("no usable features")
    order = [c for c in contract.order if c in table.columns]
    rows = table.select(FILE, ROW, S.binary_label(contract.label).alias("label"), *(F.col(c) for c in order), *(S.feature_number(c).alias(c) for c in numeric), *(F.col(c) for c in text))
    return rows, numeric, text


def profile_table(spark: SparkSession, contract: Contract) -> dict:
    """The inspection for a report: schemas may differ and the label need not be there."""
    return inspect(spark, profile_files(contract), contract, consistent=False, require_label=False)


def records_table(spark: SparkSession, records: list[dict], numeric: list[str], text: list[str]) -> DataFrame:
    """Records in memory as feature columns; an absent key is a missing cell."""
    schema = ", ".join(f"`{c}` string" for c in (*numeric, *text))
    rows = spark.createDataFrame([tuple(None if r.get(c) is None else str(r[c]) for c in (*numeric, *text)) for r in records], schema)
    return rows.select(*(S.feature_number(c).alias(c) for c in numeric), *text)
