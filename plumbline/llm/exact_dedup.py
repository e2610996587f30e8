"""Exact deduplication by a 128-bit content hash with a byte comparison inside each hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.columns import ascii_lower, join_weighted, text_or_empty

_H, _S, _T, _N = "__ed_hash", "__ed_sha", "__ed_text", "__ed_count"
_KEEP, _TEXTS = "__ed_keep", "__ed_texts"


def _hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _keyed(docs: DataFrame, normalise, hash128) -> DataFrame:
    text = normalise(text_or_empty(docs["text"]))
    return docs.withColumns({_H: hash128(text), _S: F.sha2(text, 256)})


def duplicate_groups(docs: DataFrame, *, normalise=ascii_lower, hash128=_hash128, keep: str = "max") -> DataFrame:
    """The groups of two or more equal texts: hash, SHA-256, id that stays, size.

    The first aggregate has the hash and the text itself as its key, so rows meet by the hash and
    are told apart byte by byte, and copies that one task reads become one row before the
    shuffle. The second one, without texts, counts the different texts of a hash. Texts that share
    the 128-bit hash keep their own groups, addressed by SHA-256; should two different texts ever
    share both digests, the query raises instead of merging them.
    """
    text = normalise(text_or_empty(docs["text"]))
    pick = F.max if keep == "max" else F.min
    rows = docs.select(docs["doc_id"].alias("doc_id"), text.alias(_T), hash128(text).alias(_H), F.sha2(text, 256).alias(_S))
    by_text = rows.groupBy(_H, _S, _T).agg(pick("doc_id").alias(_KEEP), F.count(F.lit(1)).alias(_N))
    groups = by_text.groupBy(_H, _S).agg(F.max(_KEEP).alias(_KEEP), F.max(_N).alias(_N), F.count(F.lit(1)).alias(_TEXTS))
    clash = F.raise_error(F.lit("different texts share a 128-bit hash and a SHA-256")).cast("long")
    return groups.where((F.col(_N) > 1) | (F.col(_TEXTS) > 1)).select(_H, _S, _KEEP, F.when(F.col(_TEXTS) > 1, clash).otherwise(F.col(_N)).alias(_N))


def exact_duplicates(docs: DataFrame, *, normalise=ascii_lower, hash128=_hash128, keep: str = "max") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if their normalised forms are; by default normalising lower-cases A to Z only
    and the row with the largest doc_id stays (``keep="min"``: the smallest). Null text counts as
    empty. Rows that repeat a doc_id with the same text count each in group_size and share their
    verdict. Null ids are passed over when choosing; a group of null ids alone keeps null, with
    kept true. An empty table gives an empty result. Columns beside doc_id and text are not read.
    """
    groups = duplicate_groups(docs, normalise=normalise, hash128=hash128, keep=keep)
    rows = _keyed(docs.select("doc_id", "text"), normalise, hash128).select("doc_id", _H, _S)
    keep_id = F.when(F.col(_N).isNull(), F.col("doc_id")).otherwise(F.col(_KEEP))
    return join_weighted(rows, groups, [_H, _S], _N, docs.count()).select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce(_N, F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.col(_S).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, *, normalise=ascii_lower, hash128=_hash128, keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns."""
    groups = duplicate_groups(docs, normalise=normalise, hash128=hash128, keep=keep)
    rows = join_weighted(_keyed(docs, normalise, hash128), groups, [_H, _S], _N, docs.count())
    return rows.where(F.col(_N).isNull() | F.col("doc_id").eqNullSafe(F.col(_KEEP))).select(*docs.columns)
