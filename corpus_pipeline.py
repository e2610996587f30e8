"""The corpus pipeline: five stages over ``documents``, each one operator of ``plumbline.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs; all but the last return the columns of documents. Columns that
documents has beside doc_id, text, lang and source go along, whatever their names. An empty table
gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.exact_dedup import drop_exact_duplicates
from plumbline.llm.language_id import fit_centroids, held_out, keep_identified
from plumbline.llm.mixing import repeat_documents
from plumbline.llm.order_minhash import drop_near_duplicates
from plumbline.llm.sentencepiece_bpe import encode_documents
from plumbline.llm.storage import remove_folder, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language the fitted centroids reject.

    Null and empty texts and texts without a letter go. The fit passes over rows without doc_id,
    text or lang; the verdict hangs on the text alone, so repeated rows share it and rows with
    null in other columns stay. Without any labelled row nothing can be identified, and all go.
    """
    return keep_identified(docs, fit_centroids(docs.where(~held_out())))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts, that with the largest doc_id.

    Null text counts as empty, so one of the null and empty texts stays. Rows that repeat both
    doc_id and text are ties that all stay; null ids give way to any other id.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the smallest doc_id.

    Texts without words, null among them, are only alike to each other. Rows that repeat a doc_id
    share its class and stay or go together; rows with a null doc_id stay.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources reach their target weights.

    A null source is a source of its own. Documents without words have size 0 and are repeated by
    their source's whole epochs only; a source without words is left out. Rows of a source that
    repeat a doc_id share their number of repeats; null ids rank as an empty id.
    """
    return repeat_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and ids of every document of the mix, repeats included.

    Null text gives null ids, empty text no ids. Repeats of a document have equal ids, as the
    draws hang on seed, doc_id and place; a null doc_id draws as 0.
    """
    return encode_documents(docs)


STAGES = [
    ("language identification", language_id),
    ("exact dedup", exact_dedup),
    ("order MinHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("SentencePiece encoding", encoding),
]

#: SQL cannot express the classifier, order MinHash or merge-dropout; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on ``documents``. What is between two of them is in the shared folder until the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = shared_folder(spark, f"pipeline-stage-{number}")
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove_folder(spark, before)
            before = path
    return docs
