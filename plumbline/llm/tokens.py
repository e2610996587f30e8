"""Byte-level BPE ids of documents, for the operators on token ids."""

from __future__ import annotations

import base64

import public_tokenizers
import tiktoken

#: Ranks of a byte-level vocabulary; the id after the last one is free and marks the end of a document.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256

_WORKER: dict[str, tiktoken.Encoding] = {}


def byte_encoding(path: str = RANKS_PATH) -> tiktoken.Encoding:
    """The encoding of a rank file, read once per Python worker. The file must be on every machine, as libraries are."""
    if path not in _WORKER:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _WORKER[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _WORKER[path]
