"""Splitting oversized texts at natural boundaries: content-defined chunking.

A rolling hash over the last ``WINDOW`` tokens marks landmarks that depend on nearby text only. Each landmark snaps
to the best natural boundary near it (paragraph, line, sentence, clause, word), and a piece ends at the
first such place between its least and greatest size. An edit therefore moves the cuts of its neighbourhood; further on the
same landmarks are met again and the pieces are the same as before.

The operator is a narrow ``mapInPandas``: no shuffle, no state beyond one text.

Defined results
---------------
* Pieces of at most ``limit`` tokens by the tokenizer's own count of the piece's text; a text within the limit is one
  piece; null and empty texts have none.
* Consecutive pieces share at least ``overlap`` tokens: a piece begins at the last character boundary at or before that
  many tokens ahead of the previous cut. Without the overlaps the pieces put together are the text.
* Cuts never fall within a character. Where no natural boundary lies near a landmark or before the greatest size,
  the cut falls at a character boundary.
* Repeated rows are split alike; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oreline.llm import tokens

WINDOW = 16
#: A token is a landmark with this chance.
SPACING = 64
#: How far, in tokens, a landmark looks for a natural boundary.
SNAP = 24
KINDS = ("none", "character", "word", "clause", "sentence", "line", "paragraph")

_GEAR = np.random.default_rng(20_240).integers(0, 2**63, 1 << 16, dtype=np.int64).astype(np.uint64)
_SENTENCE = np.array([ord(c) for c in ".!?;。！？；…"], np.uint32)
_CLAUSE = np.array([ord(c) for c in ",:)]}，：、）"], np.uint32)
_WIDE = np.array([ord(c) for c in "。！？；，：、）"], np.uint32)
_SPACE = np.array([ord(c) for c in " \t\r\n\x0b\x0c\x85            　"], np.uint32)


def rolling_hash(token_ids: np.ndarray) -> np.ndarray:
    """Gear hash of the last ``WINDOW`` tokens at each token."""
    gear = _GEAR[token_ids & 0xFFFF]
    out = np.zeros(len(gear), np.uint64)
    for j in range(min(WINDOW, len(gear))):
        out[j:] += gear[: len(gear) - j] << np.uint64(j)
    return out ^ (out >> np.uint64(29))


def boundary_ranks(text: str, ends: np.ndarray) -> np.ndarray:
    """For the place after each token its index in ``KINDS``."""
    chars = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = len(chars)
    at = np.clip(ends, 1, n)
    before, after = chars[at - 1], np.where(at < n, chars[np.minimum(at, n - 1)], 10)
    earlier = np.where(at > 1, chars[np.maximum(at - 2, 0)], 0)
    space_before, space_after = np.isin(before, _SPACE), np.isin(after, _SPACE)
    rank = np.ones(len(ends), np.int8)
    rank[space_after | space_before] = 2
    last = np.where(space_before, earlier, before)  # the mark before one blank counts for the place after it too
    apart = space_after | space_before | np.isin(before, _WIDE)
    rank[np.isin(last, _CLAUSE) & apart] = 3
    rank[np.isin(last, _SENTENCE) & apart] = 4
    line = before == 10
    rank[line & (after != 10)] = 5
    rank[line & (earlier == 10) & (after != 10)] = 6
    rank[ends < 0] = 0
    return rank


def cut_places(token_ids: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Numbers of tokens before each content-defined cut, in order."""
    marks = np.flatnonzero(rolling_hash(token_ids) % np.uint64(SPACING) == 0)
    places = []
    for m in marks:
        low, high = max(0, m - SNAP), min(len(ranks), m + SNAP + 1)
        near = ranks[low:high]
        best = np.flatnonzero(near == near.max())
        if near.max() > 1:
            places.append(low + int(best[np.argmin(np.abs(best + low - m))]) + 1)
    return np.unique(np.asarray(places, np.int64))


def split_text(text: str | None, limit: int, overlap: int, path: str = tokens.VOCABULARY) -> list[tuple[int, int, int, str]]:
    """(first character, last character + 1, tokens, kind of cut) of each piece."""
    if not text:
        return []
    token_ids = tokens.ids(text, path)
    n = len(token_ids)
    if n <= limit:
        return [(0, len(text), n, "end")]
    ends = tokens.char_ends(text, token_ids, path)
    ranks = boundary_ranks(text, ends)
    places = cut_places(token_ids, ranks)
    whole = np.flatnonzero(ranks > 0) + 1  # tokens before each character boundary
    position = np.append(0, ends)
    least = max(overlap + 1, limit // 4)
    enc = tokens.encoding(path)
    out: list[tuple[int, int, int, str]] = []
    start = cut = 0  # of the piece with its overlap; of its new part
    while True:
        room = limit
        while True:
            top = start + room
            if top >= n:
                end, kind = n, "end"
            else:
                k = np.searchsorted(places, start + least)
                if k < len(places) and max(start + least, cut + 1) <= places[k] <= top:
                    end = int(places[k])
                else:
                    span = ranks[max(start + least, cut + 1) - 1 : top]
                    if len(span) and span.max() > 0:
                        end = max(start + least, cut + 1) + int(np.flatnonzero(span == span.max())[-1])
                    else:  # a character of many tokens: the next boundary there is
                        end = int(whole[min(np.searchsorted(whole, cut + 1), len(whole) - 1)])
                kind = KINDS[ranks[end - 1]]
            a, b = int(position[start]), int(position[end])
            size = len(enc.encode_ordinary(text[a:b]))  # a cut within a word or a run of blanks changes the tokens there
            if size <= limit or room <= least + 8:
                break
            room -= max(4, size - limit)
        out.append((a, b, size, kind))
        if end >= n:
            return out
        cut = end
        back = np.searchsorted(whole, max(end - overlap, 0), "right") - 1
        start = int(whole[back]) if back >= 0 and overlap else (end if not overlap else 0)
        start = min(max(start, 0), end)


PIECES = "doc_id bigint, piece_no int, start_char bigint, end_char bigint, n_tokens int, cut string, text string"


def split_documents(docs: DataFrame, limit: int = 512, overlap: int = 32, path: str = tokens.VOCABULARY) -> DataFrame:
    """The pieces of every text of ``docs`` (doc_id, text), numbered from 1 within their document."""
    if not 0 <= overlap < limit // 4:
        raise ValueError("the overlap must be less than a quarter of the limit")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (doc, k, a, b, size, kind, text[a:b])
                for doc, text in zip(tokens.numbers(pdf["doc_id"]), pdf["text"].tolist())
                for k, (a, b, size, kind) in enumerate(split_text(text, limit, overlap, path), 1)
            ]
            out = pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_char", "end_char", "n_tokens", "cut", "text"])
            yield out.astype({"doc_id": "Int64"})

    return tokens.texts(docs).mapInPandas(split, PIECES)


def divided(pieces: DataFrame) -> DataFrame:
    """The documents that were cut, each once."""
    return pieces.where("piece_no = 2").select("doc_id").distinct()


def checked(pieces: DataFrame, docs: DataFrame, limit: int = 512) -> DataFrame:
    """(doc_id, covers, fits): whether a document's pieces cover its text from the first character to the last, each beginning no later than the one before ends,
    and whether none is above the limit. For documents with ids of their own."""
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    rows = pieces.select("doc_id", "start_char", "end_char", "n_tokens", F.lag("end_char", 1, 0).over(w).alias("before"))
    per = rows.groupBy("doc_id").agg(F.max("end_char").alias("end"), F.max(F.col("start_char") > F.col("before")).alias("gap"), F.max("n_tokens").alias("most"))
    whole = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return whole.join(per, "doc_id", "left").select("doc_id", F.coalesce((F.col("end") == F.col("n")) & ~F.col("gap"), F.lit(False)).alias("covers"), F.coalesce(F.col("most") <= limit, F.lit(False)).alias("fits"))
