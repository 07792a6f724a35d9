"""Sizes in tokens of a public byte-level BPE. The vocabulary file is a parameter, never a copy."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's published splitting pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The encoder of a rank file; one per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def byte_lengths(path: str = VOCABULARY) -> np.ndarray:
    """Bytes of each token by id."""
    enc = encoding(path)
    out = np.zeros(enc.n_vocab, np.int64)
    for token, rank in enc._mergeable_ranks.items():
        out[rank] = len(token)
    return out


def ids(text: str | None, path: str = VOCABULARY) -> np.ndarray:
    """Token ids of a text, all of it taken as ordinary text; null is empty."""
    if not text:
        return np.zeros(0, np.int64)
    return np.asarray(encoding(path).encode_ordinary(text), np.int64)


def char_ends(text: str, token_ids: np.ndarray, path: str = VOCABULARY) -> np.ndarray:
    """For each token the number of characters before its end, or -1 where it ends within a character."""
    ends = np.cumsum(byte_lengths(path)[token_ids])
    if text.isascii():
        return ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    starts = np.append((raw & 0xC0) != 0x80, True)  # a character, or the text's end, begins here
    before = np.cumsum(starts) - 1
    return np.where(starts[ends], before[ends], -1)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the id as text: pandas would turn a column of numbers and nulls into floats."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")


def numbers(ids: pd.Series) -> list[int | None]:
    """The ids of :func:`texts` as numbers again."""
    return [None if i is None or i != i else int(i) for i in ids]
