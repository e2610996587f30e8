"""Corpus operators for training data: deduplication, labelling, filtering, mixing and encoding.

Every operator takes a DataFrame with at least ``doc_id`` and ``text``; other columns may have any
name, as only columns that an operator names in its docstring are read.
"""
