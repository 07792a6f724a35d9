"""Combination and evaluation of findings."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEIGHTS = {"pattern": 0.3, "statistical": 0.3, "ml": 0.4}


def combine_methods(rows: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """One row per rule of (rule, method, confidence, ordinal): the last confidence of each method (0 where it has none), the weighted score with
    weights made to add up to 1, the mean confidence and the methods that reported the rule."""
    total = sum(weights.values())
    last = lambda m: F.coalesce(F.max(F.when(F.col("method") == m, F.struct("ordinal", "confidence")))["confidence"], F.lit(0.0)).alias(m)
    out = rows.where(F.col("method").isin(*weights)).groupBy("rule").agg(*(last(m) for m in weights), F.array_sort(F.collect_set("method")).alias("methods"))
    score = sum((F.col(m) * (w / total) for m, w in weights.items()), F.lit(0.0))
    return out.select("rule", *weights, score.alias("combined"), (sum((F.col(m) for m in weights), F.lit(0.0)) / len(weights)).alias("confidence"), "methods")


def score_summary(combined: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Mean of each method over its scores above 0, their weighted sum, and the mean confidence: one row, 0 where there is nothing."""
    total = sum(weights.values())
    means = combined.agg(*(F.coalesce(F.avg(F.when(F.col(m) > 0, F.col(m))), F.lit(0.0)).alias(m) for m in weights), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))
    return means.select(*weights, "confidence", sum((F.col(m) * (w / total) for m, w in weights.items()), F.lit(0.0)).alias("overall"))


def ensemble(rows: DataFrame, weights: Mapping[str, float], default: float = 0.2, least: float = 0.3) -> DataFrame:
    """Detections of (file, rule, line, source, confidence, severity rank): weighted mean confidence, worst severity and number of sources per
    (file, rule, line), those of at least ``least``."""
    w: Column = F.lit(default)
    for s, x in weights.items():
        w = F.when(F.col("source") == s, x).otherwise(w)
    mean = F.sum(F.col("confidence") * w) / F.sum(w)
    return rows.groupBy("file", "rule", "line").agg(mean.alias("confidence"), F.max("rank").alias("rank"), F.countDistinct("source").alias("n_sources")).where(F.round("confidence", 9) >= least)


def consensus(a: DataFrame, b: DataFrame, keys: list[str], reach: int = 3) -> DataFrame:
    """Each finding of ``a`` (keys, line, ordinal, rank) with the first finding of ``b`` (by ordinal) at most ``reach`` lines away, and the status: confirmed,
    disputed (severities more than one rank apart), only-a; findings of ``b`` that no one matched are only-b. Lines are joined by
    buckets, not by all pairs of a file; one ``b`` may confirm several ``a``."""
    width = reach + 1
    left = a.select(*keys, F.col("line").alias("line_a"), F.col("ordinal").alias("a"), F.col("rank").alias("rank_a"), F.explode(F.array(*(F.floor(F.col("line") / width) + o for o in (-1, 0, 1)))).alias("cell"))
    right = b.select(*keys, F.col("line").alias("line_b"), F.col("ordinal").alias("b"), F.col("rank").alias("rank_b"), F.floor(F.col("line") / width).alias("cell"))
    near = left.join(right, [*keys, "cell"]).where(F.abs(F.col("line_a") - F.col("line_b")) <= reach)
    best = near.groupBy("a").agg(F.min(F.struct("b", "rank_a", "rank_b")).alias("m")).select("a", "m.*")
    status = F.when(F.abs(F.col("rank_a") - F.col("rank_b")) > 1, "disputed").otherwise("confirmed")
    matched = best.select("a", "b", status.alias("status"))
    only_a = a.select(F.col("ordinal").alias("a")).join(matched, "a", "left_anti").select("a", F.lit(None).cast("bigint").alias("b"), F.lit("only-a").alias("status"))
    only_b = b.select(F.col("ordinal").alias("b")).join(matched, "b", "left_anti").select(F.lit(None).cast("bigint").alias("a"), "b", F.lit("only-b").alias("status"))
    return matched.unionByName(only_a).unionByName(only_b)


def confusion(rows: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    """Confusion counts and rates per key group (one row without keys); rates of nothing are 0."""
    t, p = F.col(truth), F.col(predicted)
    n = rows.groupBy(*keys).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = over(tp, tp + fp), over(tp, tp + fn)
    out = n.select(*keys, "tp", "fp", "fn", "tn", precision.alias("precision"), recall.alias("recall"), over(fp, fp + tn).alias("fpr"), over(tp + tn, tp + fp + fn + tn).alias("accuracy"))
    return out.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def greedy_matches(truth: DataFrame, found: DataFrame, keys: list[str], reach: int = 3) -> DataFrame:
    """(keys, truth_id, found_id, distance): every truth, in its order, takes the nearest finding at most ``reach`` lines away that is still free; the
    first of equally near ones. Sequential within a key group (one file and type), in parallel over groups."""
    kinds = dict(truth.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", truth_id {kinds['id']}, found_id {dict(found.dtypes)['id']}, distance int"

    def match(t: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        t, f = t.sort_values("id"), f.sort_values("id")
        free = {i: line for i, line in zip(f["id"].tolist(), f["line"].tolist())}
        by_line: dict[int, list[int]] = {}
        for i, line in free.items():
            by_line.setdefault(line, []).append(i)
        rows = []
        for row in t.itertuples(index=False):
            best = None
            for d in range(reach + 1):
                near = [x for line in {row.line - d, row.line + d} for x in by_line.get(line, ()) if x in free]
                if near:
                    best = (min(near), d)
                    break
            if best:
                free.pop(best[0])
            rows.append((*(getattr(row, k) for k in keys), None if row.id != row.id else row.id, best[0] if best else None, best[1] if best else None))
        out = pd.DataFrame(rows, columns=[*keys, "truth_id", "found_id", "distance"])
        ints = {c: "Int64" for c, df in (("truth_id", truth_kind), ("found_id", found_kind)) if df == "bigint"}
        return out.astype(ints | {"distance": "Int32"})

    truth_kind, found_kind = kinds["id"], dict(found.dtypes)["id"]
    return truth.select(*keys, "id", "line").groupBy(*keys).cogroup(found.select(*keys, "id", "line").groupBy(*keys)).applyInPandas(match, schema)


def first_of_runs(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that ends in a unique column."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
