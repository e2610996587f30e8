"""Digests over canonical JSON, which Spark's own JSON text would not reproduce for floats."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _plain(value: Any) -> Any:
    if isinstance(value, np.ndarray):
        return {"dtype": str(value.dtype), "shape": list(value.shape), "values": value.tolist()}
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list | tuple) else value


def canonical_sha256(value: Any) -> str:
    """``sha256:`` and the digest of JSON with sorted keys and no spaces."""
    text = json.dumps(_plain(value), sort_keys=True, separators=(",", ":"))
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def membership_sha256(clients: list[dict]) -> str:
    """The bare digest of a client list in JSON with default separators."""
    return hashlib.sha256(json.dumps(clients).encode()).hexdigest()


def canonical_sha256_column(json_text: Column) -> Column:
    """``canonical_sha256`` of the value that each JSON text holds, null for null."""

    @F.pandas_udf("string")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else canonical_sha256(json.loads(t)))

    return digest(json_text)
