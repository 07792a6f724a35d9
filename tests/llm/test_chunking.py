"""Content-defined chunking."""

from __future__ import annotations

import random

import pytest

from oreline.llm import chunking, tokens

WORDS = "the rule reaches a sink after two calls and returns early because limit tokens grow so we trace it again".split()


def prose(n, seed=0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(4, 14))).capitalize() + rng.choice(". . . ? !\n \n\n".split(" ")))
    return " ".join(out)


def rebuilt(text, pieces):
    out, at = "", 0
    for a, b, _, _ in pieces:
        assert a <= at <= b
        out += text[at:b]
        at = b
    return out


CASES = {
    "prose": prose(300), "no place to cut": "x" * 5_000, "one letter": "é" * 3_000, "chinese": "漏洞报告显示令牌泄漏。" * 300, "emoji": "👩‍💻🔥" * 600, "blanks": " " * 4_000 + "end", "lines": "\n" * 3_000,
    "digits": "0123456789" * 400, "mixed": prose(60) + "A" * 2_000 + prose(60), "carriage": "a b\r\n" * 900, "special": "<|endoftext|> " * 400,
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("limit, overlap", [(512, 32), (64, 0), (40, 8)])
def test_pieces_keep_to_the_limit_and_lose_nothing(name, limit, overlap):
    text = CASES[name]
    pieces = chunking.split_text(text, limit, overlap)
    enc = tokens.encoding()
    assert rebuilt(text, pieces) == text
    for k, (a, b, n, _) in enumerate(pieces):
        assert len(enc.encode_ordinary(text[a:b])) == n <= limit
        assert k == 0 or a < b and pieces[k - 1][1] < b


def test_overlap_and_single_pieces():
    text = prose(300)
    pieces = chunking.split_text(text, 128, 16)
    enc = tokens.encoding()
    assert len(pieces) > 5
    for x, y in zip(pieces, pieces[1:]):
        assert len(enc.encode_ordinary(text[y[0] : x[1]])) >= 14
    assert [p[:3] for p in chunking.split_text("ab", 512, 32)] == [(0, 2, 1)]
    assert chunking.split_text("", 512, 32) == [] == chunking.split_text(None, 512, 32)


def test_an_edit_changes_only_pieces_near_it():
    text = prose(600, 2)
    edited = text[:9_000] + " A new sentence stands here now." + text[9_000:]
    a = {text[x[0] : x[1]] for x in chunking.split_text(text, 256, 16)}
    b = {edited[x[0] : x[1]] for x in chunking.split_text(edited, 256, 16)}
    assert len(a - b) <= 4 and len(a & b) >= len(a) - 4


def test_frames_with_nulls_copies_and_clashing_columns(spark):
    rows = [(1, prose(200), 5, "x"), (1, prose(200), 5, "x"), (2, None, 5, None), (None, prose(200), 5, "x"), (2**60 + 1, "", 5, "x"), (2**60 + 3, prose(100), 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece_no int, cut string")
    got = chunking.split_documents(docs, 128, 8)
    ids = {r.doc_id for r in chunking.divided(got).collect()}
    assert ids == {1, None, 2**60 + 3}
    assert chunking.split_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.split_documents(docs, 100, 25)


def test_checked_finds_gaps_and_large_pieces(spark):
    kind = "doc_id bigint, piece_no int, start_char bigint, end_char bigint, n_tokens int"
    pieces = spark.createDataFrame([(1, 1, 0, 5, 3), (1, 2, 4, 9, 3), (2, 1, 0, 4, 3), (2, 2, 5, 9, 3), (3, 1, 0, 9, 600), (4, 1, 1, 9, 3), (5, 1, 0, 0, 0)], kind)
    docs = spark.createDataFrame([(k, None if k == 5 else "x" * 9) for k in range(1, 7)], "doc_id bigint, text string")
    got = {r.doc_id: (r.covers, r.fits) for r in chunking.checked(pieces, docs).collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False), 4: (False, True), 5: (True, True), 6: (False, False)}
