"""Risk scores by dimension, composites, match factors, encoders and evaluation of applications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weight of each of the 23 dimensions.
DIMENSION_WEIGHTS = {
    1: 0.15, 2: 0.10, 3: 0.20, 4: 0.10, 5: 0.05, 6: 0.10, 7: 0.10, 8: 0.08, 9: 0.07, 10: 0.05, 11: 0.06, 12: 0.07, 13: 0.04, 14: 0.05, 15: 0.06, 16: 0.05, 17: 0.04,
    18: 0.03, 19: 0.02, 20: 0.02, 21: 0.04, 22: 0.03, 23: 0.03,
}
KEPLER, ENTROPY, TOPOLOGY, CHAOS = 1, 10, 12, 13
#: What a node needs for its scores; a missing value is that of the project, then the last one given here.
NODE_DEFAULTS = {"pagerank": 0.0, "betweenness": 0.0, "in_degree": 0.0, "out_degree": 0.0, "cyclomatic": 1.0, "smells": 0.0, "input_params": 0.0, "output_vals": 0.0, "side_effects": 0.0}


def with_project_values(nodes: DataFrame, project: str, columns: Sequence[str] = ("pagerank", "betweenness")) -> DataFrame:
    """The nodes with the project's mean of each column as ``avg_<column>`` (nulls do not count)."""
    means = nodes.groupBy(project).agg(*(F.avg(c).alias(f"avg_{c}") for c in columns))
    return nodes.join(means, project)


def dimension_scores(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, dim_id, score, contribution): 23 scores of each node. ``sink_distance`` is the mean distance to sinks (.5 is the score without one), in_cycle and isolated
    are flags; values fall back to ``avg_<column>`` where the table has it, then to the defaults. Contributions use weights made to add up to 1."""
    have = set(nodes.columns)

    def value(c: str) -> Column:
        parts = [F.col(x).cast("double") for x in (c, f"avg_{c}") if x in have]
        return F.coalesce(*parts, F.lit(NODE_DEFAULTS[c]))

    flag = lambda c, x: F.when(F.coalesce(F.col(c), F.lit(False)), x).otherwise(0.0) if c in have else F.lit(0.0)
    kepler = F.coalesce(1 / (1 + F.col("sink_distance")), F.lit(0.5)) if "sink_distance" in have else F.lit(0.5)
    entropy = F.least(F.lit(1.0), (value("in_degree") + value("out_degree")) * value("cyclomatic") / 100 / 5)
    topology = flag("in_cycle", 0.3) + flag("isolated", 0.2) + F.least(F.lit(0.5), value("smells") / 10)
    chaos = F.least(F.lit(1.0), (value("input_params") + value("output_vals") + value("side_effects")) / 20 / 2)
    other = F.least(F.lit(1.0), value("pagerank") * 0.7 + value("betweenness") * 0.3)
    special = {KEPLER: kepler, ENTROPY: entropy, TOPOLOGY: topology, CHAOS: chaos}
    total = sum(DIMENSION_WEIGHTS.values())
    rows = F.array(*(F.struct(F.lit(d).alias("dim_id"), special.get(d, other).alias("score"), F.lit(w / total).alias("w")) for d, w in DIMENSION_WEIGHTS.items()))
    return nodes.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.dim_id", "r.score", (F.col("r.score") * F.col("r.w")).alias("contribution"))


def risk_level(score: Column) -> Column:
    """The level of a unified score."""
    return F.when(score >= 0.85, "critical").when(score >= 0.75, "high").when(score >= 0.5, "medium").otherwise("low")


def unified_scores(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, unified, level, top_dim): the largest contribution over the largest raw weight, at most 1, and the dimension it comes from (the first of equal ones)."""
    top = F.max(F.struct("contribution", (-F.col("dim_id")).alias("d"))).alias("m")
    unified = F.least(F.lit(1.0), F.col("m.contribution") / max(DIMENSION_WEIGHTS.values()))
    return scores.groupBy(*keys).agg(top).select(*keys, unified.alias("unified"), risk_level(unified).alias("level"), (-F.col("m.d")).alias("top_dim"))


def weighted_composite(values: Mapping[str, Column], weights: Mapping[str, float], defaults: Mapping[str, float]) -> Column:
    """Sigmoid of the weighted sum of named values, missing ones being their defaults; weights whose sum is off 1 by more than .01 are made to add up to 1."""
    total = sum(weights.values())
    scale = 1 / total if abs(total - 1) > 0.01 and total else 1.0
    s: Column = F.lit(0.0)
    for name, w in weights.items():
        s = s + w * scale * F.coalesce(values[name], F.lit(defaults.get(name, 0.0)))
    return 1 / (1 + F.exp(-s))


def composite_score(anomaly: Column, perturbation: Column, force: Column) -> Column:
    """At most 1: .4, .3 and .3 of the three means; missing ones are 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.least(F.lit(1.0), zero(anomaly) * 0.4 + zero(perturbation) * 0.3 + zero(force) * 0.3)


def match_factor(taint: Column, has_source: Column, loop_depth: Column, uninitialised: Column, overlap: Column) -> Column:
    """Factor of a hit's confidence from what surrounds it, between .1 and 2."""
    f = F.when(has_source, 1 + 0.5 * taint).otherwise(0.7) * F.when(loop_depth > 0, 1 + 0.15 * loop_depth).otherwise(1.0)
    f = f * F.when(uninitialised, 1.2).otherwise(1.0) * F.when(overlap > 0.3, 1 + 0.2 * overlap).otherwise(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(2.0), f))


def apply_genes(rows: DataFrame, keys: Sequence[str], score: str, kind: str, order: str, least: float, weights: Mapping[str, float]) -> DataFrame:
    """Candidates under a configuration: those of at least the least score, the first of each key, with the score times the weight of its type."""
    first = rows.where(F.col(score) >= least).groupBy(*keys).agg(F.min_by(F.struct(order, score, kind), order).alias("f"))
    weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), F.col(f"f.{kind}")), F.lit(1.0))
    return first.select(*keys, F.col(f"f.{order}").alias(order), (F.col(f"f.{score}") * weight).alias(score))


def index_anomalies(rows: DataFrame, order: str, n: int, threshold: float = 2.0) -> DataFrame:
    """(order, place, z, is_anomaly): the deviation of each row's *place* (from 0) among n rows, as the detector computes it: a closed form."""
    mean, sd = (n - 1) / 2, ((n * n - 1) / 12) ** 0.5 if n else 0.0
    z = F.abs(F.col("place") - mean) / sd if sd else F.lit(0.0)
    return rows.withColumn("z", z).withColumn("is_anomaly", F.col("z") > threshold).select(order, "place", "z", "is_anomaly")


def one_hot(value: Column, vocabulary: Sequence[str]) -> Column:
    """An array with 1 at the value's place in the vocabulary, all 0 where it is not there."""
    return F.transform(F.array(*map(F.lit, vocabulary)), lambda x: F.when(x == value, 1.0).otherwise(0.0))


def model_ensemble(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted mean of model scores, between 0 and 1."""
    total = sum(weights) or 1.0
    s = sum((c * (w / total) for c, w in zip(scores[1:], weights[1:])), scores[0] * (weights[0] / total))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


#: Names of one type, and shortenings of plain type names.
SYNONYMS = (
    ("sql_injection", "sqli", "sql"), ("xss", "crosssitescripting"), ("command_injection", "cmdi", "os_command_injection", "shell", "shell_command", "cmd"),
    ("path_traversal", "pathtraver", "file_write", "filewrite", "path"), ("weak_random", "weakrand", "insecure_random"), ("trust_boundary", "trustbound", "broken_access"),
    ("crypto", "cryptographic_failures", "weak_crypto"), ("hash", "insecure_hash", "weak_hash"), ("securecookie", "insecure_cookie"), ("ldap_injection", "ldapi", "ldap"),
    ("xpath_injection", "xpathi", "xpath"), ("codeinjection", "code_injection", "eval", "eval_injection", "ssjs", "ssjs_injection", "dynamic_code", "dynamiccode"),
    ("ssrf", "server_side_request_forgery", "open_redirect", "openredirect"),
)
SHORT = (("sqlinjection", "sqli"), ("commandinjection", "cmdi"), ("pathtraversal", "pathtraver"), ("weakrandom", "weakrand"), ("trustboundary", "trustbound"))


def normal_type(c: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[-_\s]", "")
    for a, b in SHORT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def same_type(a: str, b: str) -> bool:
    """Whether two type names may mean the same: equal, synonyms, or one within the other; empty names match nothing."""
    a, b = a.lower(), b.lower()
    return bool(a and b) and (a == b or any(a in s and b in s for s in SYNONYMS) or a in b or b in a)


def first_fit_matches(truth: DataFrame, found: DataFrame, keys: Sequence[str], reach: int = 5) -> DataFrame:
    """(keys, found_id, found_type, truth_id, truth_type): each finding, in its order, takes the first truth of its file that is still free, of a type that may be the same
    and at most ``reach`` lines away (a line of 0 or null is near to all). Findings without a truth and truths without a finding come out with nulls. Inputs have id,
    line, type. Sequential within a file, in parallel over files."""

    def run(t: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        t, f = t.sort_values("id", kind="stable"), f.sort_values("id", kind="stable")
        free = [(i, 0 if line != line or line is None else int(line), kind or "") for i, line, kind in zip(t["id"].tolist(), t["line"].tolist(), t["type"].tolist())]
        rows = []
        for i, line, kind in zip(f["id"].tolist(), f["line"].tolist(), f["type"].tolist()):
            line = 0 if line != line or line is None else int(line)
            hit = next((k for k, (_, at, name) in enumerate(free) if not (at and line and abs(at - line) > reach) and same_type(kind or "", name)), None)
            rows.append((i, kind, *((free[hit][0], free[hit][2]) if hit is not None else (None, None))))
            if hit is not None:
                free.pop(hit)
        rows += [(None, None, i, name) for i, _, name in free]
        held = (t if len(t) else f)[list(keys)].iloc[0].tolist()
        return pd.DataFrame([(*held, *r) for r in rows], columns=[*keys, "found_id", "found_type", "truth_id", "truth_type"])

    kinds = dict(truth.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", found_id {dict(found.dtypes)['id']}, found_type string, truth_id {kinds['id']}, truth_type string"
    names = [*keys, "id", "line", "type"]
    known = lambda df: df.select(*names).where(" and ".join(f"{k} is not null" for k in keys))
    return known(truth).groupBy(*keys).cogroup(known(found).groupBy(*keys)).applyInPandas(run, schema)


def match_rates(matches: DataFrame, keys: Sequence[str] = (), negatives: int | Column = 0) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1) of matches; ``negatives`` false positives are added. Rates of nothing are 0."""
    hit, miss = F.col("truth_id").isNotNull(), F.col("found_id").isNull()
    n = matches.groupBy(*keys).agg(F.count_if(hit & ~miss).alias("tp"), (F.count_if(~hit & ~miss) + negatives).alias("fp"), F.count_if(hit & miss).alias("fn"))
    return with_rates(n)


def with_rates(n: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def knowledge_table(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """(id, cwe, type, content) of a small knowledge base."""
    return spark.createDataFrame(list(rows), "id string, cwe string, type string, content string")


def enriched(findings: DataFrame, knowledge: DataFrame, key: str, cwe: str, kind: str, first: int = 3) -> DataFrame:
    """(key, ids): the first entries (by id) of the knowledge base for each finding's weakness or, where there is none for it, its type."""
    by = lambda c: knowledge.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("k")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, first).alias("ids"))
    a, b = by("cwe").select(F.col("k").alias(cwe), F.col("ids").alias("a")), by("type").select(F.col("k").alias(kind), F.col("ids").alias("b"))
    return findings.join(F.broadcast(a), cwe, "left").join(F.broadcast(b), kind, "left").select(key, F.coalesce("a", "b").alias("ids")).where("ids is not null")
