"""Retrieval packing."""

from __future__ import annotations

import random

from oreline.llm import packing, tokens

WORDS = "alpha beta gamma delta scan sink source rule trace token report finding patch".split()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, "s", 3) for i, t in rows], "doc_id bigint, text string, n_tokens int, container_id string, shard int")


def test_every_token_lies_in_one_container(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 20, 60, 150, 400])))) for i in range(300)]
    rows += [(900, None), (901, ""), (None, "null id"), (902, "copy text here"), (902, "copy text here"), (903, "z" * 9_000)]
    enc = tokens.encoding()
    places = packing.pack_documents(docs_of(spark, rows), capacity=128, shard_items=100).collect()
    used: dict = {}
    for p in places:
        used[p.container_id] = used.get(p.container_id, 0) + p.n_tokens
    assert max(used.values()) <= 128
    per: dict = {}
    for p in places:
        per.setdefault(p.doc_id, []).append((p.piece_no, p.start_token, p.n_tokens))
    sizes = {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
    for i, n in sizes.items():
        copies = sum(r[0] == i for r in rows)
        assert sum(x[2] for x in per[i]) == n * copies
        if n <= 128:
            assert {x[0] for x in per[i]} == {0}
        else:
            assert all(x[1] == x[0] * 128 for x in per[i])
    packed = [n for c, n in used.items() if not c.startswith("full-")]
    assert sum(packed) / (128 * len(packed)) > 0.9
    assert {r.doc_id for r in packing.divided(packing.pack_documents(docs_of(spark, rows), 128)).collect()} == {i for i, n in sizes.items() if n > 128}


def test_exact_capacity_and_empty_table(spark):
    text = " a" * 128
    assert len(tokens.encoding().encode_ordinary(text)) == 128
    got = packing.pack_documents(docs_of(spark, [(1, text), (2, text + " a"), (3, text + text)]), 128)
    assert {r.doc_id for r in packing.divided(got).collect()} == {2, 3}
    assert packing.pack_documents(docs_of(spark, []), 128).count() == 0


def test_neighbours_share_containers(spark):
    rows = [(i, ("apple pear plum fruit " if i % 2 else "engine wheel brake motor ") * 5) for i in range(40)]
    places = packing.pack_documents(docs_of(spark, rows), 64).collect()
    boxes: dict = {}
    for p in places:
        boxes.setdefault(p.container_id, []).append(p.doc_id % 2)
    mixed = sum(len(set(b)) > 1 for b in boxes.values())
    assert mixed <= 1


def test_checked_counts_what_must_not_be(spark):
    rows = [("a", 0, 1, 0, 0, 60), ("a", 1, 2, 0, 0, 70), ("b", 0, 3, 0, 0, 100), ("c", 0, 4, 0, 0, 50), ("d", 0, 4, 1, 50, 10)]
    places = spark.createDataFrame(rows, "container_id string, slot int, doc_id bigint, piece_no int, start_token bigint, n_tokens int")
    assert tuple(packing.checked(places, 100).first()) == (4, 1, 1)
    assert tuple(packing.checked(places.limit(0), 100).first()) == (0, 0, 0)
