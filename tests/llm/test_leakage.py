"""Leak search against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from oreline.llm import leakage

COMMON = [f"w{k}" for k in range(40)]


def brute(docs, items, n=leakage.RUN):
    grams: dict = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


def search(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id bigint, text string, codes string, item_id int")
    e = spark.createDataFrame([(*x, "t") for x in items], "item_id bigint, text string, topic string")
    return {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, e, **kw).collect()}


@pytest.mark.parametrize("seed, rank", [(1, 2), (2, 8), (3, 32)])
def test_no_link_is_lost_at_any_rank(spark, seed, rank):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(COMMON) if rng.random() < 0.8 else f"rare{rng.randrange(400)}" for _ in range(n)]
    items = [(i, text(rng.choice([5, 13, 20, 60]))) for i in range(12)]
    items.append((99, items[3][1] + text(4)))
    docs = []
    for d in range(60):
        w = text(rng.choice([0, 6, 13, 90, 200]))
        if d % 3 == 0:
            src = rng.choice(items)[1]
            n = rng.choice([12, 13, 14, 30])
            s = rng.randrange(max(1, len(src) - n + 1))
            at = rng.randrange(len(w) + 1)
            w = w[:at] + src[s : s + n] + w[at:]
        docs.append((d, rng.choice([" ", ", ", "\n-- "]).join(w).upper()))
    items = [(i, " ".join(w)) for i, w in items]
    want = brute(docs, items)
    assert want and search(spark, docs, items, rank=rank) == want


def planted(seed=5, n_docs=40):
    """Documents and items of one vocabulary: runs, permuted runs and unrelated texts."""
    rng = random.Random(seed)
    text = lambda n: [rng.choice(COMMON) if rng.random() < 0.5 else f"rare{rng.randrange(200)}" for _ in range(n)]
    items = [(i, " ".join(text(40))) for i in range(30)]
    docs = [(d, " ".join([*text(30), *rng.choice(items)[1].split()[5 : 18 + d % 9], *text(30)])) for d in range(n_docs)]
    return docs, items


def test_rows_come_from_the_latent_candidates(spark, monkeypatch):
    """Without the SVD (a basis of zeros) the bound lets most pairs through; with the latent space but without its candidates nothing is found."""
    docs, items = planted()
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    with_space = leakage.candidate_counts(d, e, 128).first()
    monkeypatch.setattr(leakage, "latent_basis", lambda encoded, idf, rank=1, seed=7, times=None: np.zeros((len(idf), 1)))
    without = leakage.candidate_counts(d, e, 128).first()
    assert with_space.n_runs == without.n_runs > 0 and with_space.n_candidates < 0.5 * without.n_candidates
    monkeypatch.undo()
    spaces = leakage._item_space
    monkeypatch.setattr(leakage, "_item_space", lambda *a: spaces(*a) | {"latent": np.zeros_like(spaces(*a)["latent"]), "rest": np.zeros_like(spaces(*a)["rest"]), "norm": np.zeros_like(spaces(*a)["norm"])})
    assert leakage.find_leaks(d, e, 128).count() == 0


def test_items_in_blocks_give_the_same(spark):
    docs, items = planted(6)
    assert search(spark, docs, items, block_words=200) == search(spark, docs, items) == brute(docs, items)


def test_sums_in_two_levels(spark):
    docs, items = planted(7)
    held = leakage.Items(items)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(9)
    encoded, idf = leakage._encoded(d, held)
    m = np.random.default_rng(0).standard_normal((len(idf), 3))
    want = np.zeros_like(m)
    for _, c in encoded.collect():
        c = np.frombuffer(c, np.int32)
        for k in range(0, len(c), leakage.PASSAGE):
            w = c[k : k + leakage.PASSAGE]
            v = np.zeros(len(idf))
            np.add.at(v, w[w >= 0], idf[w[w >= 0]])
            want += np.outer(v, v @ m)
    assert np.allclose(leakage.gram_times(encoded, idf, m), want, rtol=1e-3, atol=1e-2)


def test_longest_runs():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (200, leakage.PASSAGE)), rng.integers(0, 3, (200, leakage.PASSAGE))
    for k in range(0, 200, 2):
        n, i, j = rng.integers(10, 20), rng.integers(0, 6), rng.integers(0, 6)
        b[k, j : j + n] = a[k, i : i + n]
    got = leakage.longest_runs(a, b)
    for k in range(200):
        best = max((n for i in range(25) for j in range(25) for n in range(1, 26 - max(i, j)) if (a[k, i : i + n] == b[k, j : j + n]).all()), default=0)
        assert (got[k] >= leakage.RUN) == (best >= leakage.RUN)


def test_edges(spark):
    run = " ".join(f"Wort{k}é" for k in range(13))
    docs = [(1, run), (1, run), (None, run), (2, None), (3, ""), (4, run.replace(" ", "_")), (5, "x " * 5_000 + run.lower()), (6, " ".join(run.split()[:12]))]
    items = [(1, run), (2, None), (3, "short"), (None, run)]
    assert search(spark, docs, items) == {(1, 1), (None, 1), (4, 1), (5, 1)}
    assert search(spark, [], items) == set() and search(spark, docs, []) == set()


def test_chinese_and_digits_are_words():
    assert leakage.words("Ab-12，漏洞_x½") == ["ab", "12", "漏洞", "x"]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(30):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert leakage.common_subsequence(np.array(a), np.array(b)) == table[-1][-1]


def test_paraphrases(spark):
    item = "the quokka module leaks zanthor bytes while frobnicating the wimple cache under heavy load each night because nobody drains it"
    near = "the quokka module leaks many zanthor bytes while it is frobnicating the wimple cache under load each night because nobody drains it"
    filler = [(k, " ".join(random.Random(k).choice(COMMON) for _ in range(60))) for k in range(10, 400)]
    d = spark.createDataFrame([(1, near), (2, "nothing like it at all"), *filler], "doc_id bigint, text string")
    e = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_paraphrases(d, e, rare=0.01).collect()} == {(1, 7)}


def paraphrases(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    e = spark.createDataFrame(items, "item_id bigint, text string")
    return d, e, {(r.doc_id, r.item_id) for r in leakage.find_paraphrases(d, e, **kw).collect()}


def test_paraphrases_in_few_documents_and_of_often_copied_items(spark):
    """With the production parameters: no word can be rare in 20 documents; nor are those of an item that a tenth holds."""
    item = "the quokka module leaks zanthor bytes while frobnicating the wimple cache under heavy load each night because nobody drains it"
    near = "the quokka module leaks many zanthor bytes while it is frobnicating the wimple cache under load each night because nobody drains it"
    filler = [(k, " ".join(random.Random(k).choice(COMMON) for _ in range(60))) for k in range(100, 460)]
    assert paraphrases(spark, [(1, near), (2, "nothing like it at all"), *filler[:18]], [(7, item)])[2] == {(1, 7)}
    edited = [(k, near.replace("quokka", "other").replace("heavy ", "").replace("nobody", "none")) for k in range(40)]
    assert paraphrases(spark, [*edited, *filler], [(7, item)])[2] == {(k, 7) for k in range(40)}
    assert paraphrases(spark, [(1, "so be it"), *filler[:18]], [(7, "be it")])[2] == {(1, 7)}  # too short for an answer


@pytest.mark.parametrize("seed", [1, 2])
def test_paraphrases_at_any_place(spark, seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(COMMON) if rng.random() < 0.4 else f"rare{rng.randrange(300)}" for _ in range(n)]
    items = [(i, text(rng.choice([2, 8, 25, 40, 70]))) for i in range(10)]
    docs = []
    for d in range(50):
        w = text(rng.choice([0, 5, 30, 90]))
        if d % 2:
            near = [x for x in rng.choice(items)[1] if rng.random() < 0.7]
            at = rng.randrange(len(w) + 1)
            w = w[:at] + [y for x in near for y in ([x] if rng.random() < 0.85 else [x, "and"])] + w[at:]
        docs.append((d, " ".join(w)))
    d, e, got = paraphrases(spark, docs, [(i, " ".join(w)) for i, w in items])
    held, encoded, idf, basis = leakage._prepare(d, e, leakage.RANK)
    answers = leakage.answer_words(held.passages, idf, 0.005, 3)
    want = set()
    for doc, codes in encoded.collect():
        codes = np.frombuffer(codes, np.int32)
        for a in range(max(len(codes) - leakage.PASSAGE, 0) + 1):
            w = codes[a : a + leakage.PASSAGE]
            known = w[w >= 0]
            z = (basis[known] * idf[known, None]).sum(axis=0)
            for j, p in enumerate(held.passages):
                q = (basis[p] * idf[p, None]).sum(axis=0)
                share = max([np.isin(x[j], w).mean() for x in answers if len(x[j])], default=1.0)
                cos = z @ q / max(np.linalg.norm(z) * np.linalg.norm(q), 1e-9)
                if share >= 0.6 - 1e-9 and cos >= 0.5 and leakage.common_subsequence(w, p) >= 0.5 * len(p):
                    want.add((int(doc), held.ids[held.owner[j]]))
    assert want and got == want
