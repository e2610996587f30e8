"""The harmonising union of tables with different columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.scalars import trimmed


class SchemaError(ValueError):
    """Tables that cannot be put together."""


def union_columns(parts: dict[str, list[str]], *, shared: list[str], last: list[str]) -> list[str]:
    """Shared columns, ``source``, every other column in the order first seen, and the last ones."""
    for name, columns in parts.items():
        missing = [c for c in [*shared, *last] if c not in columns]
        if missing:
            raise SchemaError(f"{name} lacks {', '.join(missing)}")
    others = dict.fromkeys(c for columns in parts.values() for c in columns if c not in (*shared, *last))
    if not others:
        raise SchemaError("no columns beside the shared ones")
    return [*shared, "source", *others, *last]


def harmonised(parts: dict[str, DataFrame], *, shared: list[str], last: list[str], keep=()) -> DataFrame:
    """One table of text from several, by the rules of ``union_columns``, with the part's name in lower case as source.

    Cells are trimmed; a column that a part lacks is the empty string there. Columns in ``keep``
    (as file_ord and row_ord) go along unchanged.
    """
    names = union_columns({n: [c for c in f.columns if c not in keep] for n, f in parts.items()}, shared=shared, last=last)
    rows = [f.select(*keep, *(trimmed(F.col(f"`{c}`").cast("string")).alias(c) for c in f.columns if c not in keep), F.lit(n.lower()).alias("source")) for n, f in parts.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return whole.select(*keep, *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names))
