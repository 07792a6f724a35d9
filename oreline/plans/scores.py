"""Risk scores, encoders and evaluation over the test tables, with their SQL where SQL can say them.

The nodes that are scored are the projects: rank and share of their findings stand for centralities, runs and findings for degrees, rules for
complexity, targets for inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import code, findings, scores, stats
from oreline.operators.relational import severity_rank
from oreline.plans import code as code_plans
from oreline.plans.texts import kind_of, q
from oreline.session import table

KNOWLEDGE = (
    ("k01", "CWE-89", "sql", "bind values, do not build statements"), ("k02", "CWE-78", "cmd", "pass arguments as a list"), ("k03", "CWE-79", "xss", "escape on output"),
    ("k04", "CWE-22", "path", "resolve and compare with the root"), ("k05", "CWE-918", "ssrf", "allow named hosts only"), ("k06", "CWE-327", "weak", "use a current digest"),
    ("k07", "CWE-89", "sql", "least rights for the account"), ("k08", "CWE-611", "xxe", "switch external entities off"), ("k09", None, "race", "open with exclusive creation"),
    ("k10", "CWE-89", "sql", "log refused statements"), ("k11", "CWE-89", "sql", "review dynamic parts"), ("k12", None, "debug", "switch debugging off"),
)
GENE_WEIGHTS = {"sql": 1.2, "xss": 0.9, "path": 1.1}
VOCABULARY = ("critical", "high", "medium", "low", "info", "warning", "error")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "raw_findings").where("project_id is not null")
    n = f.groupBy("project_id").agg(
        F.avg(severity_rank("severity") / 4).alias("pagerank"), F.count(F.lit(1)).alias("out_degree"), F.countDistinct("scan_run_id").alias("in_degree"), F.countDistinct(F.lower("rule_id")).alias("cyclomatic"),
        F.countDistinct("engine").alias("input_params"), (F.count_if(F.col("code_snippet").isNull()) / F.count(F.lit(1)) * 10).alias("smells"),
    )
    total = n.agg(F.max("out_degree").alias("m"))
    n = n.crossJoin(F.broadcast(total)).withColumn("betweenness", F.when(F.col("out_degree") > 50, F.col("out_degree") / F.col("m"))).drop("m")  # one row
    n = n.withColumn("in_cycle", F.col("in_degree") > 3).withColumn("sink_distance", F.when(F.col("in_degree") > 1, F.col("in_degree").cast("double"))).withColumn("all", F.lit(1))
    return scores.with_project_values(n, "all").drop("all")


def risk_r1_dimensions(spark: SparkSession, d: str) -> DataFrame:
    s = scores.dimension_scores(_nodes(spark, d), ["project_id"])
    return s.select("project_id", "dim_id", F.round("score", 6).alias("score"), F.round("contribution", 6).alias("contribution"))


def risk_r2_unified(spark: SparkSession, d: str) -> DataFrame:
    u = scores.unified_scores(scores.dimension_scores(_nodes(spark, d), ["project_id"]), ["project_id"])
    return u.withColumn("unified", F.round("unified", 6))


def risk_r4_composite(spark: SparkSession, d: str) -> DataFrame:
    v = {"severity": F.col("pagerank"), "spread": F.col("betweenness"), "smells": F.col("smells") / 10}
    c = scores.weighted_composite(v, {"severity": 0.6, "spread": 0.5, "smells": 0.3}, {"spread": 0.2})
    return _nodes(spark, d).select("project_id", F.round(c, 6).alias("composite"))


def risk_r11_composite(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("project_id", F.round(scores.composite_score(F.col("pagerank"), F.col("betweenness"), F.col("smells") / 10), 6).alias("score"))


def risk_r15_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("project_id", *(F.round(c, 6).alias(c) for c in ("pagerank", "betweenness", "avg_pagerank", "avg_betweenness")))


def risk_r12_match(spark: SparkSession, d: str) -> DataFrame:
    src = code.lines(table(spark, d, "raw_findings"), "raw_id", "code_snippet")
    sinks = code.sink_confidence(code_plans._marks(spark, d), "raw_id").select("raw_id", "line_no", F.col("confidence").alias("taint"))
    near = code.context_overlap(src, "raw_id")
    unset = code.def_use_chains(code.flow_events(src, "raw_id"), "raw_id").where("def_line is null").select("raw_id", F.col("use_line").alias("line_no")).distinct().withColumn("unset", F.lit(True))
    hits = code.rule_hits(src, "raw_id").groupBy("raw_id", "line_no").agg(F.max("confidence").alias("base"))
    key = ["raw_id", "line_no"]
    rows = hits.join(sinks, key, "left").join(near, key, "left").join(unset, key, "left")
    f = scores.match_factor(F.coalesce("taint", F.lit(0.0)), F.col("taint").isNotNull(), F.lit(0), F.coalesce("unset", F.lit(False)), F.coalesce("overlap", F.lit(0.0)))
    return rows.select(*key, F.round(F.least(F.lit(1.0), F.col("base") * f), 6).alias("confidence")).where("confidence >= 0.2")


def risk_r13_genes(spark: SparkSession, d: str) -> DataFrame:
    conf = F.lower(F.trim("confidence"))
    rows = table(spark, d, "raw_findings").select("scan_run_id", "file_path", "start_line", "raw_id", kind_of().alias("kind"), F.when(conf == "high", 0.9).when(conf == "medium", 0.6).when(conf == "low", 0.3).otherwise(0.1).alias("score"))
    out = scores.apply_genes(rows, ["scan_run_id", "file_path", "start_line"], "score", "kind", "raw_id", 0.3, GENE_WEIGHTS)
    return out.select("raw_id", F.round("score", 6).alias("score"))


def stat_m10_index(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey")
    ends = p.agg(F.min("p_partkey").alias("low"), F.count(F.lit(1)).alias("n")).first()
    placed = p.withColumn("place", F.col("p_partkey") - ends.low)  # keys run without gaps: the place needs no global sort
    return scores.index_anomalies(placed, "p_partkey", ends.n, 1.5).select("p_partkey", F.round("z", 6).alias("z"), "is_anomaly")


def stat_m6_forest(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "raw_findings").where("project_id is not null").groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("project_id", F.round(stats.forest_scores(F.col("n")), 6).alias("score"), (stats.forest_scores(F.col("n")) > 0.6).alias("is_anomaly"))


def stat_m18_ensemble(spark: SparkSession, d: str) -> DataFrame:
    e = scores.model_ensemble([F.col("l_discount") * 12, F.col("l_tax") * 10], [0.6, 0.9])
    return table(spark, d, "lineitem").groupBy(F.round(e, 6).alias("score")).agg(F.count(F.lit(1)).alias("n"))


def stat_m27_one_hot(spark: SparkSession, d: str) -> DataFrame:
    hot = scores.one_hot(F.lower("severity"), VOCABULARY)
    return table(spark, d, "raw_findings").select(F.posexplode(hot).alias("place", "x")).groupBy("place").agg(F.sum("x").alias("n"))


def join_m22_enriched(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_findings").select("raw_id", F.get("cwe_ids", F.lit(0)).alias("cwe"), kind_of().alias("kind"))
    return scores.enriched(rows, scores.knowledge_table(spark, KNOWLEDGE), "raw_id", "cwe", "kind").select("raw_id", F.array_join("ids", ",").alias("ids"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "findings").select("scan_run_id", F.lower("file_path").alias("file"), "id", F.col("start_line").alias("line"), scores.normal_type(kind_of()).alias("type")).distinct()
    found = table(spark, d, "raw_findings").select("scan_run_id", F.lower("file_path").alias("file"), F.col("raw_id").alias("id"), F.col("start_line").alias("line"), scores.normal_type(kind_of()).alias("type"))
    return scores.first_fit_matches(truth, found, ["scan_run_id", "file"])


def eval_j18_first_fit(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d)


def eval_v2_rates(spark: SparkSession, d: str) -> DataFrame:
    base = F.lower(F.element_at(F.split("file_path", "/"), -1)).alias("file")
    t = table(spark, d, "findings").select("scan_run_id", base, F.col("rule_id").alias("rule"), "id", F.col("start_line").alias("line")).where("line is not null").distinct()
    f = table(spark, d, "raw_findings").select("scan_run_id", base, F.lower("rule_id").alias("rule"), F.col("raw_id").alias("id"), F.col("start_line").alias("line")).where("line is not null")
    m = findings.greedy_matches(t, f, ["scan_run_id", "file", "rule"]).where("truth_id is not null")
    tp, n_truth, n_found = m.where("found_id is not null").count(), t.count(), f.count()
    one = spark.createDataFrame([(tp, n_found - tp, n_truth - tp)], "tp bigint, fp bigint, fn bigint")
    return scores.with_rates(one)


def eval_v3_projects(spark: SparkSession, d: str) -> DataFrame:
    clean = table(spark, d, "scan_runs").where("status = 'failed'").select(F.col("id").alias("scan_run_id")).distinct()
    wrong = table(spark, d, "raw_findings").join(clean, "scan_run_id", "left_semi").select("scan_run_id", F.lower("file_path").alias("file")).distinct().groupBy("scan_run_id").agg(F.count(F.lit(1)).alias("negatives"))
    n = scores.match_rates(_matched(spark, d), ["scan_run_id"]).drop("precision", "recall", "f1").join(wrong, "scan_run_id", "left")
    return scores.with_rates(n.withColumn("fp", F.col("fp") + F.coalesce("negatives", F.lit(0))).drop("negatives"))


QUERIES = {f.__name__: f for f in (
    risk_r1_dimensions, risk_r2_unified, risk_r4_composite, risk_r11_composite, risk_r12_match, risk_r13_genes, risk_r15_nodes, stat_m6_forest, stat_m10_index, stat_m18_ensemble, stat_m27_one_hot, join_m22_enriched,
    eval_j18_first_fit, eval_v2_rates, eval_v3_projects,
)}

_RANK = "CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_NODES = f"""n0 AS (SELECT project_id, avg({_RANK} / 4) AS pr, count(*) AS od, count(DISTINCT scan_run_id) AS ind, count(DISTINCT lower(rule_id)) AS cyc, count(DISTINCT engine) AS inp, count(*) FILTER (WHERE code_snippet IS NULL) / count(*) * 10 AS smells FROM raw_findings WHERE project_id IS NOT NULL GROUP BY 1),
 n1 AS (SELECT *, CASE WHEN od > 50 THEN od / max(od) OVER () END AS bw FROM n0), nd AS (SELECT *, avg(pr) OVER () AS apr, avg(bw) OVER () AS abw FROM n1)"""
_TOTAL = sum(scores.DIMENSION_WEIGHTS.values())
_DIMS = f"""{_NODES}, w AS (SELECT * FROM (VALUES {', '.join(f'({k}, {v}::double)' for k, v in scores.DIMENSION_WEIGHTS.items())}) v(dim_id, weight)),
 sc AS (SELECT project_id, dim_id, weight / {_TOTAL}::double AS w, CASE dim_id WHEN 1 THEN CASE WHEN ind > 1 THEN 1 / (1 + ind) ELSE 0.5 END WHEN 10 THEN least(1, (ind + od) * cyc / 100.0 / 5) WHEN 12 THEN CASE WHEN ind > 3 THEN 0.3 ELSE 0 END + least(0.5, smells / 10)
   WHEN 13 THEN least(1, inp / 20.0 / 2) ELSE least(1, coalesce(pr, apr, 0) * 0.7 + coalesce(bw, abw, 0) * 0.3) END::double AS score FROM nd, w)"""
_NULL = "NULL"
_BY = f"(VALUES {', '.join(f'({q(i)}, {q(c) if c else _NULL}, {q(t)})' for i, c, t, _ in KNOWLEDGE)}) v(id, cwe, kind)"

SQL = {
    "risk_r1_dimensions": f"WITH {_DIMS} SELECT project_id, dim_id, round(score, 6) AS score, round(score * w, 6) AS contribution FROM sc",
    "risk_r2_unified": f"WITH {_DIMS}, m AS (SELECT project_id, (max({{'c': score * w, 'd': -dim_id}})) AS m FROM sc GROUP BY 1), u AS (SELECT project_id, least(1, m.c / 0.20::double) AS u, -m.d AS top_dim FROM m) SELECT project_id, round(u, 6) AS unified, CASE WHEN u >= 0.85 THEN 'critical' WHEN u >= 0.75 THEN 'high' WHEN u >= 0.5 THEN 'medium' ELSE 'low' END AS level, top_dim FROM u",
    "risk_r4_composite": f"WITH {_NODES} SELECT project_id, round(1 / (1 + exp(-(0.6 * pr + 0.5 * coalesce(bw, 0.2) + 0.3 * smells / 10) / 1.4)), 6) AS composite FROM nd",
    "risk_r11_composite": f"WITH {_NODES} SELECT project_id, round(least(1, pr * 0.4 + coalesce(bw, 0) * 0.3 + smells / 10 * 0.3), 6) AS score FROM nd",
    "risk_r15_nodes": f"WITH {_NODES} SELECT project_id, round(pr, 6) AS pagerank, round(bw, 6) AS betweenness, round(apr, 6) AS avg_pagerank, round(abw, 6) AS avg_betweenness FROM nd",
    "risk_r13_genes": f"""WITH s AS (SELECT scan_run_id, file_path, start_line, raw_id, lower(split_part(rule_id, '-', 2)) AS kind, CASE lower(trim(confidence)) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.1 END AS score FROM raw_findings),
 f AS (SELECT *, row_number() OVER (PARTITION BY scan_run_id, file_path, start_line ORDER BY raw_id) AS rn FROM s WHERE score >= 0.3) SELECT raw_id, round((score * CASE kind WHEN 'sql' THEN 1.2 WHEN 'xss' THEN 0.9 WHEN 'path' THEN 1.1 ELSE 1 END)::double, 6) AS score FROM f WHERE rn = 1""",
    "stat_m6_forest": "WITH n AS (SELECT project_id, least(count(*), 256) AS s FROM raw_findings WHERE project_id IS NOT NULL GROUP BY 1), c AS (SELECT project_id, CASE WHEN s < 2 THEN 1 WHEN s = 2 THEN 2 ** (-ln(2) / (2 * 0.5772156649 - 1)) ELSE 2 ** (-ln(s) / (2 * (ln(s - 1) + 0.5772156649) - 2 * (s - 1) / s)) END AS x FROM n) SELECT project_id, round(x, 6) AS score, x > 0.6 AS is_anomaly FROM c",
    "stat_m10_index": "WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i, count(*) OVER () AS n FROM part), z AS (SELECT p_partkey, abs(i - (n - 1) / 2) / sqrt((n * n - 1) / 12) AS z FROM p) SELECT p_partkey, round(z, 6) AS z, z > 1.5 AS is_anomaly FROM z",
    "stat_m18_ensemble": "SELECT round(greatest(0, least(1, l_discount * 12 * 0.4::double + l_tax * 10 * 0.6::double)), 6) AS score, count(*) AS n FROM lineitem GROUP BY 1",
    "stat_m27_one_hot": f"SELECT v.place, coalesce(n, 0)::double AS n FROM (VALUES {', '.join(f'({k}, {q(x)})' for k, x in enumerate(VOCABULARY))}) v(place, x) LEFT JOIN (SELECT lower(severity) AS x, count(*) AS n FROM raw_findings GROUP BY 1) s ON s.x = v.x",
    "join_m22_enriched": f"""WITH b AS (SELECT * FROM {_BY}), r AS (SELECT raw_id, cwe_ids[1] AS cwe, lower(split_part(rule_id, '-', 2)) AS kind FROM raw_findings),
 c AS (SELECT cwe, array_to_string(list_sort(list(id))[1:3], ',') AS ids FROM b WHERE cwe IS NOT NULL GROUP BY 1), t AS (SELECT kind, array_to_string(list_sort(list(id))[1:3], ',') AS ids FROM b GROUP BY 1)
 SELECT raw_id, coalesce(c.ids, t.ids) AS ids FROM r LEFT JOIN c USING (cwe) LEFT JOIN t ON t.kind = r.kind WHERE coalesce(c.ids, t.ids) IS NOT NULL""",
}
