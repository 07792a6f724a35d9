"""Evaluation texts leaking into training text: latent semantic retrieval with checks.

The evaluation items are a stated query set, taken in blocks. Their words are the vocabulary; document frequencies of these
words come from all documents. Documents and items are cut into passages of ``PASSAGE`` words, ``STEP`` apart, so that every
run of ``RUN`` words lies wholly in some passage. A randomised SVD of the documents' TF-IDF passages (a Gaussian sketch
and one power iteration, summed over partitions in two levels) gives the latent space in which passages are compared.

Candidates come from the latent space alone, and the search loses nothing. For passages d and q the inner product is at most

    <Pd, Pq> + |d - Pd| |q - Pq|

with P the projection on the latent space. Passages that share a run s of RUN words have <d, q> >= |s|^2, and |s|^2 is at
least the smallest such value over the runs of q. So a pair whose latent cosine, with the known residuals added, stays below
that item's own threshold cannot share a run. The higher the rank, the smaller the residuals and the fewer the candidates
(``candidate_counts`` reports them). Each candidate pair is then compared word by word: longest common run for verbatim
leaks; longest common subsequence and the item's rarest words (its answer) for paraphrases.

Scale: documents are encoded once (word numbers, -1 outside the vocabulary). Passages whose norm is below every item's threshold are left
out without loss; the SVD and the search read only the others. Nothing about documents reaches the driver but sums over
the items' vocabulary. A block holds about ``BLOCK_WORDS`` words of items, so what is broadcast is bounded however many items there are.

Defined results
---------------
* A word is a longest run of letters or digits of any script, in lower case; all else separates.
* Null or empty texts, and items under RUN words, share no run. Repeated documents are each reported; repeated rows
  of one pair come out once. No items or no documents: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oreline.llm import tokens
from oreline.session import cut_lineage

RUN = 13
STEP = RUN
PASSAGE = RUN + STEP - 1
#: Words by which windows of the grid are widened to hold every run of PASSAGE words.
MARGIN = STEP // 2
#: Dimensions of the latent space of the verbatim search, and of paraphrases, which look for likeness in the large.
SEARCH_RANK = 768
RANK = 32
OVERSAMPLE = 8
#: Words of the items that are searched in one pass over the documents.
BLOCK_WORDS = 40_000
#: Rows of a matrix that are sent and summed together.
ROWS = 64
#: Passages from which one partial sum of the SVD comes.
PART_PASSAGES = 16_384
WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def words(text: str | None) -> list[str]:
    """The words of a text, in lower case."""
    return [w.lower() for w in WORD.findall(text)] if text else []


def starts(n: int) -> np.ndarray:
    """First words of the passages of a text of ``n`` words."""
    return np.arange(0, max(n - PASSAGE + STEP, 1), STEP) if n else np.zeros(0, np.int64)


class Items:
    """The evaluation items as word numbers, and their passages."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in rows]
        texts = [words(t) for _, t in rows]
        self.vocab = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
        self.words = [np.array([self.vocab[w] for w in t], np.int32) for t in texts]
        self.owner: list[int] = []
        self.passages: list[np.ndarray] = []
        for k, t in enumerate(self.words):
            for s in starts(len(t)):
                self.owner.append(k)
                self.passages.append(t[s : s + PASSAGE])

    def padded(self, none: int) -> np.ndarray:
        """The passages as rows of PASSAGE word numbers, ``none`` after their ends."""
        out = np.full((len(self.passages), PASSAGE), none, np.int32)
        for k, p in enumerate(self.passages):
            out[k, : len(p)] = p
        return out

    def least_runs(self, idf: np.ndarray) -> np.ndarray:
        """For each passage the least squared norm of a run of RUN words in it; infinite for shorter ones."""
        n = len(idf)
        windows = np.lib.stride_tricks.sliding_window_view(self.padded(n), RUN, axis=1)
        norms = squared_norms(windows.reshape(-1, RUN), idf).reshape(len(windows), -1)
        return np.where((windows == n).any(axis=2), np.inf, norms).min(axis=1)


def encode(docs: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """(doc_id, codes): the documents as word numbers, 4 bytes each."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = shared.value.get
        for pdf in batches:
            codes = [np.array([get(w, -1) for w in words(t)], np.int32).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "codes": codes})

    return tokens.texts(docs).mapInPandas(run, "doc_id string, codes binary")


def inverse_frequencies(encoded: DataFrame, n_vocab: int) -> np.ndarray:
    """Smoothed inverse document frequencies of the vocabulary, over all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(n_vocab + 1, np.int64)
        for pdf in batches:
            for c in pdf["codes"]:
                w = np.unique(np.frombuffer(c, np.int32))
                df[w[w >= 0]] += 1
            df[n_vocab] += len(pdf)
        k = np.flatnonzero(df)
        yield pd.DataFrame({"word": k.astype(np.int32), "df": df[k]})

    rows = encoded.mapInPandas(count, "word int, df bigint").groupBy("word").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(n_vocab + 1)
    df[rows["word"].to_numpy(np.int64)] = rows["df"].to_numpy()
    return (np.log((df[n_vocab] + 1) / (df[:n_vocab] + 1)) + 1).astype(np.float32)


def _passages(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of many documents end to end, with the first and last + 1 word of each passage."""
    codes = [np.frombuffer(c, np.int32) for c in batch]
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    begin, end, base = [], [], 0
    for c in codes:
        s = starts(len(c))
        begin.append(s + base)
        end.append(np.minimum(s + PASSAGE, len(c)) + base)
        base += len(c)
    none = [np.zeros(0, np.int64)]
    return flat, np.concatenate(begin or none), np.concatenate(end or none)


def _slices(batches: Iterator[pd.DataFrame], n_words: int = 60_000) -> Iterator[tuple[list, list[bytes]]]:
    """Documents in groups of about ``n_words`` words."""
    ids, held, size = [], [], 0
    for pdf in batches:
        for i, c in zip(pdf["doc_id"].tolist(), pdf["codes"]):
            ids.append(i)
            held.append(c)
            size += len(c) // 4
            if size >= n_words:
                yield ids, held
                ids, held, size = [], [], 0
    if held:
        yield ids, held


def _summed(parts: DataFrame, n: int, width: int) -> np.ndarray:
    """The sum of matrices sent as (block, part) rows: first within groups of partitions, then over the groups, so that no task
    holds more than about the square root of all parts."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in pdf["part"])
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [total.astype(np.float32).tobytes()]})

    kind = "block int, part binary"
    groups = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    some = parts.withColumn("g", F.spark_partition_id() % groups).groupBy("block", "g").applyInPandas(add, kind)
    out = np.zeros((n, width), np.float32)
    for block, part in some.groupBy("block").applyInPandas(add, kind).collect():  # the vocabulary's size, whatever the documents
        k = block * ROWS
        out[k : min(k + ROWS, n)] = np.frombuffer(part, np.float32).reshape(-1, width)
    return out


def _scatter(total: np.ndarray, flat: np.ndarray, passage: np.ndarray, weighted: np.ndarray) -> None:
    """Add (A'A W) of some passages, given as words and their passage numbers in order, to ``total``."""
    if not len(flat):
        return
    turns = np.flatnonzero(np.diff(passage, prepend=-1))
    z = np.add.reduceat(weighted[flat], turns, axis=0)
    row = np.repeat(np.arange(len(turns)), np.diff(np.append(turns, len(flat))))
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    total[keys] += np.add.reduceat(z[row[order]], first, axis=0)


def _blocks(total: np.ndarray) -> pd.DataFrame:
    k = [b for b in range(-(-len(total) // ROWS)) if total[b * ROWS : (b + 1) * ROWS].any()]
    return pd.DataFrame({"block": np.array(k, np.int32), "part": [total[b * ROWS : (b + 1) * ROWS].astype(np.float32).tobytes() for b in k]})


def gram_times(encoded: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """A'A times a matrix, A being the TF-IDF vectors of the documents' passages, laid end to end: one pass over
    the documents."""
    n, width = matrix.shape
    shared = encoded.sparkSession.sparkContext.broadcast(((matrix * idf[:, None]).astype(np.float32), idf))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, idf = shared.value
        total = np.zeros((n, width))
        for _, held in _slices(batches):
            codes = [np.frombuffer(c, np.int32) for c in held]
            lengths = np.array([len(c) for c in codes])
            flat = np.concatenate(codes)
            # passages end to end, none over the end of its document
            before = np.repeat(np.cumsum(lengths) - lengths, lengths)
            passage = (np.arange(len(flat)) - before) // PASSAGE + np.repeat(np.cumsum(-(-lengths // PASSAGE)) - -(-lengths // PASSAGE), lengths)
            known = flat >= 0
            _scatter(total, flat[known], passage[known], w)
        yield _blocks(total * idf[:, None])

    out = _summed(encoded.mapInPandas(run, "block int, part binary"), n, width)
    shared.destroy()
    return out


def passages_times(passages: DataFrame, idf: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The same over the rows of :func:`search_passages`."""
    n, width = matrix.shape
    shared = passages.sparkSession.sparkContext.broadcast(((matrix * idf[:, None]).astype(np.float32), idf))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, idf = shared.value
        total = np.zeros((n, width))
        for pdf in batches:
            for raw in pdf["codes"]:
                rows = np.frombuffer(raw, np.int32).reshape(-1, PASSAGE)
                for k in range(0, len(rows), 512):
                    part = rows[k : k + 512]
                    i, c = np.nonzero(part < n)
                    _scatter(total, part[i, c], i, w)
        yield _blocks(total * idf[:, None])

    out = _summed(passages.mapInPandas(run, "block int, part binary"), n, width)
    shared.destroy()
    return out


def latent_basis(encoded: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7, times=gram_times) -> np.ndarray:
    """Orthonormal right singular vectors (vocabulary x rank) of the documents' TF-IDF passages."""
    n = len(idf)
    width = min(rank + OVERSAMPLE, n)
    q, _ = np.linalg.qr(times(encoded, idf, np.random.default_rng(seed).standard_normal((n, width), np.float32)))
    image = times(encoded, idf, q)
    small = (q.T @ image).astype(np.float64)
    del image
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return np.ascontiguousarray(q @ vectors[:, ::-1][:, : min(rank, width)].astype(np.float32))


def squared_norms(ids: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Squared TF-IDF norms of passages given as rows of word numbers; the vocabulary's size stands for none."""
    weight = np.append(idf, 0).astype(np.float64) ** 2
    rows = np.sort(ids, axis=1)
    out = weight[rows].sum(axis=1)
    for lag in range(1, rows.shape[1]):
        same = (rows[:, lag:] == rows[:, :-lag]) & (rows[:, lag:] < len(idf))
        if not same.any():
            break
        out += 2 * (weight[rows[:, lag:]] * same).sum(axis=1)
    return out


def longest_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common runs of words of many pairs, given as two arrays of rows of PASSAGE words; 0 where it is sure to be below RUN."""
    middle = RUN - 1  # a run of RUN words covers the middle of either passage
    good = np.flatnonzero((a == b[:, middle, None]).any(axis=1) & (b == a[:, middle, None]).any(axis=1))
    out = np.zeros(len(a), np.int8)
    out[good] = _longest_runs(a[good], b[good])
    return out


def _longest_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    row = np.zeros((len(a), b.shape[1] + 1), np.int8)
    best = np.zeros(len(a), np.int8)
    for k in range(a.shape[1]):
        row[:, 1:] = (row[:, :-1] + 1) * (a[:, k, None] == b)
        np.maximum(best, row.max(axis=1), out=best)
    return best


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, row by row over numpy arrays."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        new = np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def _item_space(items: Items, idf: np.ndarray, basis: np.ndarray) -> dict:
    weighted = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    flat = np.concatenate(items.passages)
    ends = np.cumsum([len(p) for p in items.passages])
    latent = np.concatenate([np.add.reduceat(weighted[flat[a:b]], np.append(0, e[:-1] - a), axis=0) for e, a, b in _runs_of(ends)])
    total = squared_norms(items.padded(len(idf)), idf)
    rest = np.sqrt(np.maximum(total - (latent.astype(np.float64) ** 2).sum(axis=1), 0))
    return {"latent": latent, "rest": rest, "norm": np.sqrt(total), "least": items.least_runs(idf), "owner": np.array(items.owner, np.int64)}


def _runs_of(ends: np.ndarray, size: int = 1_024) -> Iterator[tuple[np.ndarray, int, int]]:
    """Groups of passages that lie end to end: their ends, and the first and last + 1 word of the group."""
    for k in range(0, len(ends), size):
        part = ends[k : k + size]
        yield part, int(ends[k - 1]) if k else 0, int(part[-1])


def _windows(flat: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    at = begin[:, None] + np.arange(PASSAGE)
    inside = at < end[:, None]
    rows = flat[np.minimum(at, max(len(flat) - 1, 0))]
    return np.where(inside & (rows >= 0), rows, n)


def item_blocks(eval_items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of about ``block_words`` words by a hash of their id; one block at a time is on the driver."""
    held = eval_items.where("item_id is not null").select("item_id", "text")
    size = held.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"[^\p{L}\p{Nd}]+"))), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_words))
    for k in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield Items([(r[0], r[1]) for r in part.orderBy("item_id").collect()])


def _encoded(docs: DataFrame, held: Items) -> tuple[DataFrame, np.ndarray]:
    encoded = cut_lineage(encode(docs, held.vocab))
    return encoded, inverse_frequencies(encoded, len(held.vocab))


def _prepare(docs: DataFrame, eval_items: DataFrame, rank: int):
    held = next(item_blocks(eval_items, 2**62))
    encoded, idf = _encoded(docs, held)
    basis = latent_basis(encoded, idf, rank) if len(idf) else np.zeros((0, 1))
    return held, encoded, idf, basis


def search_passages(encoded: DataFrame, idf: np.ndarray, lowest: float) -> DataFrame:
    """(docs, codes): the passages that have RUN words of the vocabulary in a row and whose squared norm reaches ``lowest``, some hundred a row;
    words outside the vocabulary are numbered with its size. The others share no run with any item, as |d|^2 >= |s|^2 for each run s of d."""
    n = len(idf)
    shared = encoded.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, codes in _slices(batches):
            flat, begin, end = _passages(codes)
            if not len(begin):
                continue
            rows = _windows(flat, begin, end, n)
            known = np.cumsum(np.pad(rows < n, ((0, 0), (1, 0))), axis=1, dtype=np.int8)
            at = np.flatnonzero((known[:, RUN:] - known[:, :-RUN] == RUN).any(axis=1))
            at = at[squared_norms(rows[at], shared.value) >= lowest * (1 - 1e-4)]
            if len(at):
                doc_of = np.searchsorted(np.cumsum([len(starts(len(c) // 4)) for c in codes]), at, "right")
                yield pd.DataFrame({"docs": [[docs[int(d)] for d in doc_of]], "codes": [rows[at].astype(np.int32).tobytes()]})

    return encoded.mapInPandas(run, "docs array<string>, codes binary")


def candidates(rows: np.ndarray, space: dict, weighted: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passages, item passages): pairs whose latent cosine, with the residuals, allows a common run. Passages shorter than RUN words
    have an infinite threshold and are no candidates."""
    limit, norm, rest = (space[k].astype(np.float32) for k in ("least", "norm", "rest"))
    for k in range(0, len(rows), 512):
        part = rows[k : k + 512]
        norms = squared_norms(part, idf)
        z = np.add.reduceat(weighted[part.ravel()], np.arange(0, part.size, PASSAGE), axis=0)
        away = np.sqrt(np.maximum(norms - (z.astype(np.float64) ** 2).sum(axis=1), 0))
        bound = z @ space["latent"].T
        bound += np.outer(away.astype(np.float32), rest)
        bound += np.outer((1e-3 * np.sqrt(norms)).astype(np.float32), norm)  # rounding
        i, j = np.nonzero(bound >= limit[None, :])
        yield k + i, j


def _searched(docs: DataFrame, held: Items, rank: int):
    """The passages to search, what the searching tasks need of the items, and the basis; None where nothing can be found."""
    if not held.passages:
        return None
    encoded, idf = _encoded(docs, held)
    least = held.least_runs(idf)
    if not np.isfinite(least).any():
        return None
    passages = cut_lineage(search_passages(encoded, idf, float(least.min())))
    total = passages.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)).alias("n")).first().n
    basis = latent_basis(passages.repartition(max(1, -(-total // PART_PASSAGES))), idf, rank, times=passages_times)
    space = _item_space(held, idf, basis)
    weighted = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    return passages, docs.sparkSession.sparkContext.broadcast((space, weighted, idf, held.padded(-1), held.ids))


def candidate_counts(docs: DataFrame, eval_items: DataFrame, rank: int = SEARCH_RANK) -> DataFrame:
    """(n_passages, n_item_passages, n_candidates, n_runs): how many pairs the latent search passes on, and how many of them share a run."""
    kind = "n_passages bigint, n_item_passages bigint, n_candidates bigint, n_runs bigint"
    out = docs.sparkSession.createDataFrame([], kind)
    for held in item_blocks(eval_items):
        searched = _searched(docs, held, rank)
        if searched is None:
            continue
        passages, shared = searched

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            space, weighted, idf, padded, _ = shared.value
            n = [0, 0, 0]
            for pdf in batches:
                for raw in pdf["codes"]:
                    rows = np.frombuffer(raw, np.int32).reshape(-1, PASSAGE)
                    n[0] += len(rows)
                    for i, j in candidates(rows, space, weighted, idf):
                        n[1] += len(i)
                        n[2] += sum(int((longest_runs(rows[i[e : e + 4_096]], padded[j[e : e + 4_096]]) >= RUN).sum()) for e in range(0, len(i), 4_096))
            yield pd.DataFrame({"n_passages": [n[0]], "n_item_passages": [len(padded)], "n_candidates": [n[1]], "n_runs": [n[2]]})

        out = out.unionByName(passages.mapInPandas(count, kind))
    return out.agg(F.sum("n_passages").alias("n_passages"), F.max("n_item_passages").alias("n_item_passages"), F.sum("n_candidates").alias("n_candidates"), F.sum("n_runs").alias("n_runs"))


def find_leaks(docs: DataFrame, eval_items: DataFrame, rank: int = SEARCH_RANK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_passages) of all documents and items that share RUN consecutive words; n_passages counts the pairs of passages that do."""
    kind = "doc_id string, item_id bigint, n_passages int"
    found = None
    for held in item_blocks(eval_items, block_words):
        searched = _searched(docs, held, rank)
        if searched is None:
            continue
        passages, shared = searched

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            space, weighted, idf, padded, ids = shared.value
            for pdf in batches:
                for docs, raw in zip(pdf["docs"], pdf["codes"]):
                    rows = np.frombuffer(raw, np.int32).reshape(-1, PASSAGE)
                    hits: dict[tuple[int, int], int] = {}
                    name: dict[str | None, int] = {}
                    place = np.array([name.setdefault(x, len(name)) for x in docs])
                    for i, j in candidates(rows, space, weighted, idf):
                        for e in range(0, len(i), 4_096):
                            ie, je = i[e : e + 4_096], j[e : e + 4_096]
                            good = longest_runs(rows[ie], padded[je]) >= RUN
                            for pair in zip(place[ie[good]].tolist(), space["owner"][je[good]].tolist()):
                                hits[pair] = hits.get(pair, 0) + 1
                    who = list(name)
                    yield pd.DataFrame([(who[a], ids[b], c) for (a, b), c in hits.items()], columns=["doc_id", "item_id", "n_passages"])

        part = passages.mapInPandas(search, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], kind.replace("string", "bigint"))
    return found.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "item_id").agg(F.sum("n_passages").cast("int").alias("n_passages"))


def answer_words(passages: list[np.ndarray], idf: np.ndarray, rare: float, least_rare: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each passage its words found in at most a share ``rare`` of all documents (none where they are fewer than
    ``least_rare``), and the rarer half of its words by rank (none where it has fewer than
    ``least_rare`` words at all)."""
    by_share, by_rank = [], []
    for p in passages:
        w = np.unique(p)
        w = w[np.lexsort((w, -idf[w]))]
        seldom = w[idf[w] >= 1 - np.log(rare)]
        by_share.append(seldom if len(seldom) >= least_rare else w[:0])
        by_rank.append(w[: max(least_rare, -(-len(w) // 2))] if len(w) >= least_rare else w[:0])
    return by_share, by_rank


def common_subsequences(same: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of many pairs, given as (pair, word of one, word of the other) equalities."""
    row = np.zeros((len(same), same.shape[2] + 1), np.int16)
    for k in range(same.shape[1]):
        row[:, 1:] = np.maximum.accumulate(np.maximum(row[:, 1:], np.where(same[:, k], row[:, :-1] + 1, 0)), axis=1)
    return row[:, -1]


class _Asked:
    """Which passages ask for a word, to count the words of each passage that windows hold."""

    def __init__(self, wanted: list[np.ndarray], n: int):
        self.size = np.array([len(a) for a in wanted])
        word = np.concatenate(wanted)
        order = np.argsort(word, kind="stable")
        self.by = np.repeat(np.arange(len(wanted)), self.size)[order]
        self.first = np.searchsorted(word[order], np.arange(n + 1))

    def held(self, i: np.ndarray, word: np.ndarray, n_windows: int) -> np.ndarray:
        """(window, passage): words that are held; i and word list each window's words once."""
        many = self.first[word + 1] - self.first[word]
        at = np.repeat(self.first[word], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.bincount(np.repeat(i, many) * len(self.size) + self.by[at], minlength=n_windows * len(self.size)).reshape(n_windows, -1)


def find_paraphrases(docs: DataFrame, eval_items: DataFrame, rank: int = RANK, cosine: float = 0.5, common: float = 0.5, answer: float = 0.6, rare: float = 0.005, least_rare: int = 3) -> DataFrame:
    """(doc_id, item_id, cosine, common, answer): PASSAGE consecutive words anywhere in a document (all words of a shorter one)
    that are like an item's passage in the latent space, whose words follow each other as the item's do (longest common
    subsequence over the passage's length) and that hold its answer: a share ``answer`` of the words found in at most a share
    ``rare`` of all documents, if the passage has ``least_rare`` of them, or of the rarer half of its words by rank. The rank
    holds on few documents, and on items so often copied that their words are common. Passages of fewer than ``least_rare``
    different words have no answer; cosine and subsequence decide.

    Every passage is searched. Windows of the grid, wider by MARGIN words on both sides, hold every run of PASSAGE words; those that
    hold enough words of a passage are then checked at each place a run may begin."""
    kind = "doc_id string, item_id bigint, cosine double, common double, answer double"
    held, encoded, idf, basis = _prepare(docs, eval_items, rank)
    if not held.passages or not len(idf):
        return docs.sparkSession.createDataFrame([], kind.replace("string", "bigint"))
    n = len(idf)
    space = _item_space(held, idf, basis)
    answers = answer_words(held.passages, idf, rare, least_rare)
    weighted = np.vstack([basis * idf[:, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((space, weighted, held.passages, held.ids, answers))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space, weighted, passages, ids, answers = shared.value
        unit = space["latent"] / np.maximum(np.linalg.norm(space["latent"], axis=1), 1e-9)[:, None]
        asked = [_Asked(a, n) for a in answers]
        every = _Asked([np.unique(p) for p in passages], n)
        free = (asked[0].size == 0) & (asked[1].size == 0)
        size = np.array([len(p) for p in passages])
        padded = np.full((len(passages), PASSAGE), -2, np.int32)
        answer_at = [np.zeros(padded.shape, bool) for _ in answers]  # the first place of each answer word
        most = np.zeros(len(passages), np.int64)  # places of a passage that repeat a word
        for j, p in enumerate(passages):
            padded[j, : len(p)] = p
            word, place = np.unique(p, return_index=True)
            most[j] = len(p) - len(word)
            for marks, a in zip(answer_at, answers):
                marks[j, place[np.isin(word, a[j])]] = True
        shift = np.arange(-(STEP // 2), STEP // 2 + 1)
        for docs, codes in _slices(batches):
            flat, begin, end = _passages(codes)
            if not len(begin):
                continue
            lengths = np.array([len(c) // 4 for c in codes])
            last = np.cumsum(lengths)
            doc_of = np.searchsorted(np.cumsum([len(starts(m)) for m in lengths]), np.arange(len(begin)), "right")
            low, high = (last - lengths)[doc_of], last[doc_of]
            sums = np.zeros((len(flat) + 1, weighted.shape[1]), np.float64)
            np.cumsum(weighted[flat], axis=0, out=sums[1:])
            rows = []
            for k in range(0, len(begin), 1_024):
                part = slice(k, k + 1_024)
                lo, hi = low[part], high[part]
                at = np.maximum(begin[part] - MARGIN, lo)[:, None] + np.arange(PASSAGE + 2 * MARGIN)
                wide = np.where(at < np.minimum(end[part] + MARGIN, hi)[:, None], flat[np.minimum(at, len(flat) - 1)], n)
                wide = np.sort(np.where(wide < 0, n, wide), axis=1)
                wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = n  # each word once
                i, word = np.repeat(np.arange(len(wide)), wide.shape[1]), wide.ravel()
                i, word = i[word < n], word[word < n]
                fits = np.broadcast_to(free, (len(wide), len(free))).copy()
                for x in asked:
                    fits |= (x.held(i, word, len(wide)) >= answer * x.size - 1e-9) & (x.size > 0)
                fits &= every.held(i, word, len(wide)) + most >= common * size
                w, j = np.nonzero(fits)
                for c in range(0, len(w), 2_048):
                    wc, jc = w[c : c + 2_048], j[c : c + 2_048]
                    # each place where a run of the document may begin that is nearest to this window of the grid
                    first = begin[part][wc][:, None] + shift
                    ok = (first >= lo[wc][:, None]) & (first <= np.maximum(hi[wc] - PASSAGE, lo[wc])[:, None])
                    where = np.flatnonzero(ok.ravel())
                    first, wc, jc = first.ravel()[where], np.repeat(wc, len(shift))[where], np.repeat(jc, len(shift))[where]
                    stop = np.minimum(first + PASSAGE, hi[wc])
                    z = sums[stop] - sums[first]
                    near = np.einsum("ij,ij->i", z, unit[jc]) / np.maximum(np.linalg.norm(z, axis=1), 1e-9)
                    keep = near >= cosine
                    first, stop, wc, jc, near = first[keep], stop[keep], wc[keep], jc[keep], near[keep]
                    for e in range(0, len(first), 4_096):
                        f, s, q = first[e : e + 4_096], stop[e : e + 4_096], jc[e : e + 4_096]
                        at = f[:, None] + np.arange(PASSAGE)
                        codes_at = np.where(at < s[:, None], flat[np.minimum(at, len(flat) - 1)], -1)
                        same = codes_at[:, :, None] == padded[q][:, None, :]
                        has = same.any(axis=1)
                        share = np.where(free[q], 1.0, 0.0)
                        for marks, x in zip(answer_at, asked):
                            share = np.maximum(share, (has & marks[q]).sum(axis=1) / np.maximum(x.size[q], 1))
                        good = np.flatnonzero((share >= answer - 1e-9) & (has.sum(axis=1) >= common * size[q]))
                        both = common_subsequences(same[good]) / size[q[good]]
                        for g, b in zip(good[both >= common].tolist(), both[both >= common].tolist()):
                            rows.append((docs[int(doc_of[k + wc[e + g]])], ids[int(space["owner"][q[g]])], float(near[e + g]), b, float(share[g])))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "common", "answer"])

    found = encoded.mapInPandas(search, kind)
    return found.groupBy(F.col("doc_id").cast("bigint").alias("doc_id"), "item_id").agg(*(F.round(F.max(c), 4).alias(c) for c in ("cosine", "common", "answer")))


def leak_report(leaks: DataFrame, docs: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Per item: topic, split, documents that hold it and the sources they come from; items that did not leak have 0."""
    held = leaks.join(docs.select("doc_id", "source"), "doc_id", "left").groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("source").alias("n_sources"))
    return eval_items.select("item_id", "topic", "split").distinct().join(held, "item_id", "left").select("item_id", "topic", "split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))
