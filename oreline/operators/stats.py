"""Statistics, entropies, anomaly scores and vector search.

Moments are aggregated on the map side and joined back, so a group with a third of all rows is no hot spot. Vector search compares
blocks: queries are packed into matrices and every block of rows is scored with one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def z_scores(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows with ``z``: distance from the group's mean in population standard deviations, 0 where there is no spread."""
    m = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return df.join(m, list(keys)).withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def covariances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, cov): sample covariances of all pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*(F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs))
    return one.select(F.explode(each).alias("x")).select("x.*")


def diagonal_distance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows with ``distance``: Mahalanobis distance with a diagonal covariance; a variance of 0 counts as 1."""
    row = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.var_samp(c).alias(f"v_{c}") for c in columns)).first()
    total: Column = F.lit(0.0)
    for c in columns:
        d = F.col(c) - F.lit(row[f"m_{c}"])
        total = total + d * d / F.lit(row[f"v_{c}"] or 1.0)
    return df.withColumn("distance", F.sqrt(total))


def forest_score(n: int, sample: int = 256) -> float:
    """The score that every point gets from trees whose root is a leaf (the scanner's forest): a closed form of the sample's size."""
    s = min(sample, n)
    if s < 2:
        return 1.0
    c = 2 * (np.log(s - 1) + 0.5772156649) - 2 * (s - 1) / s
    return float(2 ** (-np.log(s) / c)) if c else 1.0


def forest_scores(n: Column, sample: int = 256) -> Column:
    """:func:`forest_score` as a column of group sizes."""
    s = F.least(n, F.lit(sample))
    c = 2 * (F.log(s - 1) + 0.5772156649) - 2 * (s - 1) / s
    return F.when(s < 2, 1.0).otherwise(F.pow(F.lit(2.0), -F.log(s) / c))


def entropy_by(df: DataFrame, keys: Sequence[str], value: Column, name: str = "h") -> DataFrame:
    """Entropy in bits of a value's distribution per key group, and the entropy over the logarithm of the number of values."""
    counts = df.groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    t = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_l"))
    h = F.log2("_n") - F.col("_l") / F.col("_n")
    return t.select(*keys, h.alias(name), F.when(F.col("_n") > 1, h / F.log2("_n")).otherwise(0.0).alias(f"{name}_normal"))


def spectrum(signal: DataFrame, n: int) -> DataFrame:
    """(k, period, amplitude): discrete Fourier amplitudes over 0.5 of a signal (t, x) of length n, periods between 1 and n."""
    angle = 2 * np.pi * F.col("k") * F.col("t") / n
    parts = signal.select("t", "x", F.explode(F.sequence(F.lit(1), F.lit((n - 1) // 2))).alias("k")).groupBy("k").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    amp = F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) / n
    return parts.select("k", (F.lit(float(n)) / F.col("k")).alias("period"), amp.alias("amplitude")).where("amplitude > 0.5 and period > 1 and period < %d" % n)


BLOCK_ROWS = 512
#: Queries up to which their vectors are broadcast.
MAX_QUERIES = 50_000


def _blocks(df: DataFrame, name: str) -> DataFrame:
    """Rows (id, vector) packed into blocks of up to BLOCK_ROWS, within their partitions."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []
        for pdf in batches:
            for i, v in zip(pdf["id"].tolist(), pdf["vector"]):
                if v is None or not len(v):
                    continue
                ids.append(i)
                vectors.append(np.asarray(v, np.float32))
                if len(ids) == BLOCK_ROWS:
                    yield pd.DataFrame({f"{name}_ids": [np.array(ids)], f"{name}_raw": [np.stack(vectors).tobytes()]})
                    ids, vectors = [], []
        if ids:
            yield pd.DataFrame({f"{name}_ids": [np.array(ids)], f"{name}_raw": [np.stack(vectors).tobytes()]})

    return df.mapInPandas(pack, f"{name}_ids array<bigint>, {name}_raw binary")


def top_similar(queries: DataFrame, rows: DataFrame, k: int, threshold: float) -> DataFrame:
    """(query_id, id, cosine, place): for each query (id, vector) its ``k`` most similar other rows with a cosine of at least ``threshold``;
    ties go to the smaller id. A stated query set is scored against all rows, block by block; each pair of blocks hands on at most
    k rows a query."""
    asked = _blocks(queries, "q")
    few = queries.count() <= MAX_QUERIES
    # blocks, not rows; the stated queries are sent to the rows where they have been counted and are few, else both are cut into parts that meet
    pairs = _blocks(rows, "r").crossJoin(F.broadcast(asked)) if few else _blocks(rows, "r").crossJoin(asked.hint("shuffle_replicate_nl"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for q_ids, q_raw, r_ids, r_raw in pdf[["q_ids", "q_raw", "r_ids", "r_raw"]].itertuples(index=False):
                q_ids, r_ids = np.asarray(q_ids), np.asarray(r_ids)
                q, r = (np.frombuffer(raw, np.float32).reshape(len(ids), -1).astype(np.float64) for ids, raw in ((q_ids, q_raw), (r_ids, r_raw)))
                q, r = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (q, r))
                cos = np.round(q @ r.T, 6)
                cos[q_ids[:, None] == r_ids[None, :]] = -2
                order = np.lexsort((np.broadcast_to(r_ids, cos.shape), -cos), axis=1)[:, :k]
                best = np.take_along_axis(cos, order, 1)
                i, j = np.nonzero(best >= threshold)
                yield pd.DataFrame({"query_id": q_ids[i], "id": r_ids[order[i, j]], "cosine": best[i, j]})

    found = pairs.mapInPandas(score, "query_id bigint, id bigint, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
