"""Filling containers of fixed capacity with documents: lexical retrieval packing.

Texts above the capacity are cut into full containers and a rest; all other texts stay whole. The items are spread over
shards of alike size by a lexical signature, so that items which share words tend to meet, and each shard holds a BM25 inverted index of its
items (terms are token ids; document frequencies come from all items of the corpus). The largest unused item seeds a container; its
scored unused neighbours, all of them, fill the window greedily from the best on, and the room that none of them fits is given to the
largest unused items that do fit.

Scale: a shard holds about ``SHARD_ITEMS`` items of at most one container each, so its memory is bounded
whatever the corpus, its sources or its longest texts; a signature that more items share is spread over several shards by a hash of the id. What
reaches the driver is one number per vocabulary entry: the frequencies, and the sizes of the signatures.

Defined results
---------------
* Every row of ``docs`` lies in containers with all of its tokens; null and empty texts are items of size 0.
* A container's sizes add up to at most the capacity. Only a text above the capacity has more than one piece.
* Equal copies are items of their own. Ties go to the smaller (doc_id, piece), so results do not depend on
  the order of rows; rows with the same id and text are told apart by nothing and may swap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oreline.llm import tokens
from oreline.session import cut_lineage

SHARD_ITEMS = 4_096
K1, B = 1.2, 0.75
#: Neighbours that are put in order together.
BLOCK = 64

ITEMS = "doc_id bigint, piece_no int, start_token bigint, n_tokens int, is_full boolean, terms array<int>, counts array<int>, signature int"
#: ``placed_by`` says how an item came to its place: as seed, as neighbour by score, by size, or as a full piece.
PLACES = "container_id string, slot int, doc_id bigint, piece_no int, start_token bigint, n_tokens int, placed_by string"


def signature(terms: np.ndarray) -> int:
    """The term with the least hash among the rarer quarter (by vocabulary rank) of an item's terms: items share it about as often as they share
    such terms. -1 for items without terms."""
    if not len(terms):
        return -1
    rare = terms[-(-3 * len(terms) // 4) :] if len(terms) > 3 else terms  # terms are in the order of their ids
    return int(rare[np.argmin((rare.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16))])


def document_items(docs: DataFrame, capacity: int, path: str = tokens.VOCABULARY) -> DataFrame:
    """The full pieces and the whole texts or rests of every document, rests with their term counts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text in zip(tokens.numbers(pdf["doc_id"]), pdf["text"].tolist()):
                ids = tokens.ids(text, path)
                full = len(ids) // capacity
                rows += [(doc, k, k * capacity, capacity, True, None, None, -1) for k in range(full)]
                rest = ids[full * capacity :]
                if len(rest) or not full:
                    terms, counts = np.unique(rest, return_counts=True)
                    rows.append((doc, full, full * capacity, len(rest), False, terms.astype(np.int32), counts.astype(np.int32), signature(terms)))
            out = pd.DataFrame(rows, columns=["doc_id", "piece_no", "start_token", "n_tokens", "is_full", "terms", "counts", "signature"])
            yield out.astype({"doc_id": "Int64"})

    return tokens.texts(docs).mapInPandas(cut, ITEMS)


def document_frequencies(items: DataFrame, n_vocab: int) -> np.ndarray:
    """In how many items each token id occurs; partial arrays are summed before they are sent."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_vocab, np.int64)
        for pdf in batches:
            held = [np.asarray(t, np.int64) for t in pdf["terms"] if t is not None]
            if held:
                total += np.bincount(np.concatenate(held), minlength=n_vocab)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"term": seen.astype(np.int32), "df": total[seen]})

    rows = items.select("terms").mapInPandas(count, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    out = np.zeros(n_vocab, np.int64)
    out[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return out


def pack_shard(items: pd.DataFrame, idf: np.ndarray, mean_size: float, capacity: int) -> list[list[tuple[int, str]]]:
    """Containers of one shard as lists of row numbers with how each was placed, seeds first."""
    sizes = items["n_tokens"].to_numpy(np.int64)
    n = len(items)
    terms = [np.asarray(t if t is not None else (), np.int64) for t in items["terms"]]
    lengths = np.array([len(t) for t in terms])
    flat = np.concatenate(terms) if n else np.zeros(0, np.int64)
    tf = np.concatenate([np.asarray(c if c is not None else (), np.float32) for c in items["counts"]]) if n else np.zeros(0)
    owner = np.repeat(np.arange(n), lengths)
    order = np.argsort(flat, kind="stable")
    flat, tf, owner = flat[order], tf[order], owner[order]
    norm = K1 * (1 - B + B * sizes / max(mean_size, 1.0))
    weight = (idf[flat] * tf * (K1 + 1) / (tf + norm[owner])).astype(np.float32)
    first = np.searchsorted(flat, np.arange(len(idf) + 1))
    # the lists of terms that many items hold are laid out in full: at most eight times the mean number of an item's terms
    often = np.flatnonzero(np.diff(first) > n / 8)
    common, common_row = np.zeros((len(often), n), np.float32), np.full(len(idf), -1, np.int32)
    common_row[often] = np.arange(len(often))
    for k, t in enumerate(often):
        common[k, owner[first[t] : first[t + 1]]] = weight[first[t] : first[t + 1]]
    unused = sizes > 0
    by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
    seeds = sorted(np.flatnonzero(unused).tolist(), key=lambda i: (-sizes[i], i))
    for i in reversed(seeds):
        by_size[sizes[i]].append(i)
    held = np.array([len(x) for x in by_size])
    out: list[list[tuple[int, str]]] = []

    def take(i: int) -> None:
        unused[i] = False
        held[sizes[i]] -= 1

    for seed in seeds:
        if not unused[seed]:
            continue
        take(seed)
        box, room = [(seed, "seed")], capacity - int(sizes[seed])
        if room and held[1 : room + 1].any():
            rows = common_row[terms[seed]]
            score = common[rows[rows >= 0]].sum(axis=0)
            few = terms[seed][rows < 0]
            for a, b in zip(first[few].tolist(), first[few + 1].tolist()):
                score[owner[a:b]] += weight[a:b]  # an item stands once in a term's list
            score[~unused | (sizes > room)] = 0
            left = np.flatnonzero(score > 0)
            while len(left):  # the best block of those that are left, then the next, until nothing fits
                got = score[left]
                bar = np.partition(got, -BLOCK)[-BLOCK] if len(left) > BLOCK else 0
                near, left = left[got >= bar], left[got < bar]
                near = near[np.lexsort((near, -score[near]))]
                while len(near := near[sizes[near] <= room]):
                    take(near[0])
                    box.append((int(near[0]), "score"))
                    room -= int(sizes[near[0]])
                    near = near[1:]
                left = left[sizes[left] <= room]
            while room:
                fits = np.flatnonzero(held[1 : room + 1])
                if not len(fits):
                    break
                stack = by_size[fits[-1] + 1]
                while not unused[stack[-1]]:
                    stack.pop()
                i = stack.pop()
                take(i)
                box.append((i, "size"))
                room -= int(sizes[i])
        out.append(box)
    empty = [(i, "size") for i in np.flatnonzero(sizes == 0).tolist()]
    if empty:
        if out:
            out[-1] += empty
        else:
            out.append(empty)
    return out


def lexical_shards(rests: DataFrame, shard_items: int) -> Column:
    """The shard of an item: whole signatures in a row, about ``shard_items`` items a shard; larger ones have shards of their own."""
    sizes = rests.groupBy("signature").count().toPandas()  # at most one row a vocabulary entry
    first, parts, shard, held = {}, {}, 0, 0
    for sig, n in sorted(zip(sizes["signature"].tolist(), sizes["count"].tolist())):
        if held and held + n > shard_items:
            shard, held = shard + 1, 0
        first[sig] = shard
        if n > shard_items:
            parts[sig] = -(-n // shard_items)
            shard, held = shard + parts[sig], 0
        else:
            held += n
    spark = rests.sparkSession
    top = max(first, default=0)
    begin = [first.get(s, 0) for s in range(-1, top + 1)]
    width = [parts.get(s, 1) for s in range(-1, top + 1)]
    shared = spark.sparkContext.broadcast((np.array(begin, np.int32), np.array(width, np.int32)))

    @F.pandas_udf("int")
    def place(signature: pd.Series, spread: pd.Series) -> pd.Series:
        begin, width = shared.value
        k = signature.to_numpy() + 1
        return pd.Series(begin[k] + spread.to_numpy() % width[k])

    return place("signature", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(2**31 - 1)).cast("int"))


def pack_documents(docs: DataFrame, capacity: int = 2_048, path: str = tokens.VOCABULARY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(container_id, slot, doc_id, piece_no, start_token, n_tokens): where every text lies."""
    spark = docs.sparkSession
    items = cut_lineage(document_items(docs, capacity, path))
    rests = items.where("not is_full")
    n_vocab = tokens.encoding(path).n_vocab
    df = document_frequencies(rests, n_vocab)
    total = rests.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("mean")).first()
    idf = np.log1p((total.n - df + 0.5) / (df + 0.5)).astype(np.float32)
    shared, mean = spark.sparkContext.broadcast(idf), float(total["mean"])  # one float a vocabulary entry
    shard = lexical_shards(rests, shard_items)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(doc_id=pd.array(tokens.numbers(pdf["doc_id"]), "Int64")).sort_values(["doc_id", "piece_no", "n_tokens"], kind="stable", ignore_index=True)
        boxes = pack_shard(pdf, shared.value, mean, capacity)
        rows = np.array([i for box in boxes for i, _ in box], np.int64)
        shard = pdf["shard"].iloc[0]
        out = pdf.iloc[rows][["doc_id", "piece_no", "start_token", "n_tokens"]].reset_index(drop=True)
        out.insert(0, "container_id", [f"{shard}-{k}" for k, box in enumerate(boxes) for _ in box])
        out.insert(1, "slot", np.array([s for box in boxes for s in range(len(box))], np.int32))
        out["placed_by"] = [how for box in boxes for _, how in box]
        return out

    packed = rests.withColumn("shard", shard).withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("shard").applyInPandas(pack, PLACES)
    full = items.where("is_full").select(F.concat(F.lit("full-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"), F.lit(0).alias("slot"), "doc_id", "piece_no", "start_token", "n_tokens", F.lit("full").alias("placed_by"))
    return full.unionByName(packed)


def divided(places: DataFrame) -> DataFrame:
    """The documents that lie in more than one piece, each once."""
    return places.where("piece_no = 1").select("doc_id").distinct()


def fill_report(places: DataFrame, capacity: int = 2_048) -> DataFrame:
    """Containers, tokens and share of room used, over all containers and those that are not full pieces; and the shares of tokens that were placed
    beside a seed by score and by size."""
    by = lambda how: F.sum(F.when(F.col("placed_by") == how, F.col("n_tokens")).otherwise(0)).alias(how)
    per = places.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_items"), by("score"), by("size"))
    kind = F.when(F.col("container_id").startswith("full-"), "full").otherwise("packed").alias("kind")
    return per.groupBy(kind).agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("largest"), F.round(F.sum("used") / (F.count(F.lit(1)) * capacity), 4).alias("fill"), *(F.round(F.sum(c) / F.greatest(F.sum("used"), F.lit(1)), 4).alias(f"by_{c}") for c in ("score", "size")))


def checked(places: DataFrame, capacity: int = 2_048) -> DataFrame:
    """(n_documents, n_over_full, n_needlessly_divided): documents placed, containers over the capacity, and documents of at most the capacity with
    more than one piece."""
    used = places.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > capacity).alias("n_over_full"))
    per = places.groupBy("doc_id").agg(F.sum("n_tokens").alias("size"), F.max("piece_no").alias("last"))
    docs = per.agg(F.count("doc_id").alias("n_documents"), F.count_if((F.col("size") <= capacity) & (F.col("last") > 0)).alias("n_needlessly_divided"))
    return docs.crossJoin(used).select("n_documents", "n_over_full", "n_needlessly_divided")  # one row each
