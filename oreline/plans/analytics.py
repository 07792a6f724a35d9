"""Graph, statistics, combination, evaluation and log queries over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oreline.operators import findings, graph, logs, stats
from oreline.operators.relational import severity_rank
from oreline.session import table


# --- graphs: consecutive event types per user (small, dense), customers and nations (large, sparse) -------------

def _steps(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null")


def _home(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))


def _supply(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))


def _ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "id string")


def graph_g1_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_home(spark, d))


def graph_g3_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_supply(spark, d))


def graph_g5_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_steps(spark, d)).select("id", F.round("rank", 6).alias("rank"))


def graph_g6_closure(spark: SparkSession, d: str) -> DataFrame:
    return graph.closure(_steps(spark, d))


def graph_g8_levels(spark: SparkSession, d: str) -> DataFrame:
    return graph.levels(_steps(spark, d), _ids(spark, "click", "error"))


def graph_g9_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_paths(_steps(spark, d), _ids(spark, "click")).select(F.array_join("path", ">").alias("path"))


def graph_g12_crossing(spark: SparkSession, d: str) -> DataFrame:
    return graph.crossing(_steps(spark, d), _ids(spark, "click", "view"), _ids(spark, "error")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def graph_g13_induced(spark: SparkSession, d: str) -> DataFrame:
    return graph.induced(_steps(spark, d), _ids(spark, "click", "view", "error")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def graph_g19_junctions(spark: SparkSession, d: str) -> DataFrame:
    return graph.junctions(_steps(spark, d)).select("id", "kind", F.round("ratio", 6).alias("ratio"))


def graph_a23_counts(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


# --- statistics -----------------------------------------------------------------------------------------------

def stat_m2_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return stats.z_scores(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value").where("abs(z) > 2").select("event_id", F.round("z", 5).alias("z"))


def stat_m3_covariance(spark: SparkSession, d: str) -> DataFrame:
    return stats.covariances(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).select("a", "b", F.round("cov", 5).alias("cov"))


def stat_m5_diagonal(spark: SparkSession, d: str) -> DataFrame:
    return stats.diagonal_distance(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).where("distance > 3").select("l_orderkey", "l_linenumber", F.round("distance", 4).alias("distance"))


def stat_m8_one_class(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    centre = e.select(F.posexplode("embedding").alias("k", "x")).groupBy("k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    dist = e.select("vec_id", F.posexplode("embedding").alias("k", "x")).join(centre, "k").groupBy("vec_id").agg(F.sqrt(F.sum((F.col("x").cast("double") - F.col("m")) ** 2)).alias("dist"))
    top = dist.agg(F.max("dist")).first()[0]
    return dist.select("vec_id", F.round(F.col("dist") / F.lit(top or 1.0), 5).alias("score"))


def stat_m12_entropy(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "usage_events").where("provider is not null")
    return stats.entropy_by(u, ["provider"], F.col("model")).select("provider", F.round("h", 6).alias("h"), F.round("h_normal", 6).alias("h_normal"))


def stat_m13_spectrum(spark: SparkSession, d: str) -> DataFrame:
    hours = table(spark, d, "events").groupBy(F.hour("ts").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    return stats.spectrum(hours, 24).select("k", F.round("period", 5).alias("period"), F.round("amplitude", 4).alias("amplitude"))


def stat_m15_pooling(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def stat_m21_similar(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return stats.top_similar(e.where("id % 50 = 0"), e, 5, 0.3).select("query_id", "id", F.round("cosine", 4).alias("cosine"))


def stat_a18_summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("l_discount") * 10
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.percentile(v, 0.25), 6).alias("q25"), F.round(F.percentile(v, 0.75), 6).alias("q75"), F.round(F.avg(F.when(v >= 0.5, 1.0).otherwise(0.0)), 6).alias("high_ratio"))


def risk_r3_levels(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_discount") * 10
    by_score = F.when(s < 0.25, "LOW").when(s < 0.5, "MEDIUM").when(s < 0.85, "HIGH").otherwise("CRITICAL")
    other = F.when(s >= 0.85, "CRITICAL").when(s >= 0.75, "HIGH").when(s >= 0.5, "MEDIUM").otherwise("LOW")
    return table(spark, d, "lineitem").groupBy(by_score.alias("by_score"), other.alias("by_threshold")).agg(F.count(F.lit(1)).alias("n"))


def risk_r6_hash(spark: SparkSession, d: str) -> DataFrame:
    chars = F.transform(F.split("file_path", ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(chars, F.lit(5381).cast("bigint"), lambda a, c: (a * 33 + c).bitwiseAND(F.lit(2147483647).cast("bigint")))
    return table(spark, d, "raw_findings").select("file_path").distinct().select("file_path", (h % 10000).alias("bucket"))


# --- combination and evaluation -----------------------------------------------------------------------------------

def _conf() -> Column:
    c = F.lower("confidence")
    return F.when(c == "high", 0.9).when(c == "medium", 0.6).when(c == "low", 0.3).otherwise(0.1)


def _detections(spark: SparkSession, d: str) -> DataFrame:
    method = F.when(F.col("engine") == "semgrep", "pattern").when(F.col("engine") == "dfg", "statistical").otherwise("ml")
    return table(spark, d, "raw_findings").select(F.lower("rule_id").alias("rule"), method.alias("method"), _conf().alias("confidence"), F.col("raw_id").alias("ordinal"))


def comb_e3_scores(spark: SparkSession, d: str) -> DataFrame:
    c = findings.combine_methods(_detections(spark, d))
    return c.select("rule", "pattern", "statistical", "ml", F.round("combined", 6).alias("combined"), F.round("confidence", 6).alias("confidence"), F.array_join("methods", "+").alias("methods"))


def comb_a16_summary(spark: SparkSession, d: str) -> DataFrame:
    s = findings.score_summary(findings.combine_methods(_detections(spark, d)))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


def comb_e5_ensemble(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_findings").select(F.col("file_path").alias("file"), F.lower("rule_id").alias("rule"), F.col("start_line").alias("line"), F.col("engine").alias("source"), _conf().alias("confidence"), severity_rank("severity").alias("rank"))
    return findings.ensemble(rows, {"semgrep": 0.3, "dfg": 0.3}).select("file", "rule", "line", F.round("confidence", 6).alias("confidence"), "rank", "n_sources")


def comb_e6_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_findings")
    cwe = F.max(F.when(F.size("cwe_ids") > 0, F.struct((-F.col("raw_id")).alias("o"), F.element_at("cwe_ids", 1).alias("cwe"))))
    return rows.groupBy("scan_run_id", "rule_id", "file_path", "start_line").agg(F.max(severity_rank("severity")).alias("rank"), cwe.alias("c"), F.min("raw_id").alias("first_id")).select("first_id", "rank", F.col("c.cwe").alias("cwe"))


def comb_e7_consensus(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_findings").select("scan_run_id", "file_path", F.lower("rule_id").alias("rule"), F.col("start_line").alias("line"), F.col("raw_id").alias("ordinal"), severity_rank("severity").alias("rank"), "engine")
    return findings.consensus(rows.where("engine = 'semgrep'"), rows.where("engine <> 'semgrep'"), ["scan_run_id", "file_path", "rule"])


def eval_v1_confusion(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "training_samples").select((F.col("label") == 1).alias("truth"), F.coalesce(F.col("code").rlike(r"(?i)strcpy|sprintf|eval\(|system\(|md5|exec\("), F.lit(False)).alias("predicted"))
    return _rounded(findings.confusion(t, [], "truth", "predicted"))


def eval_a22_per_cwe(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "training_samples").where("vulnerability_type is not null").select("vulnerability_type", (F.col("label") == 1).alias("truth"), F.coalesce(F.col("code").rlike(r"(?i)strcpy|sprintf|eval\(|system\(|md5|exec\("), F.lit(False)).alias("predicted"))
    return _rounded(findings.confusion(t, ["vulnerability_type"], "truth", "predicted"))


def _rounded(c: DataFrame) -> DataFrame:
    return c.select(*(F.round(n, 6).alias(n) if k == "double" else F.col(n) for n, k in c.dtypes))


def eval_v4_matrix(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_findings").withColumn("sev", F.lower("severity"))
    return rows.groupBy("engine").pivot("sev", ["critical", "high", "medium", "low"]).agg(F.count(F.lit(1))).na.fill(0)


def eval_j17_greedy(spark: SparkSession, d: str) -> DataFrame:
    base = F.lower(F.element_at(F.split("file_path", "/"), -1)).alias("file")
    t = table(spark, d, "findings").select("scan_run_id", base, F.col("rule_id").alias("rule"), "id", F.col("start_line").alias("line")).where("line is not null").distinct()
    f = table(spark, d, "raw_findings").select("scan_run_id", base, F.lower("rule_id").alias("rule"), F.col("raw_id").alias("id"), F.col("start_line").alias("line")).where("line is not null")
    return findings.greedy_matches(t, f, ["scan_run_id", "file", "rule"]).where("truth_id is not null")


# --- logs --------------------------------------------------------------------------------------------------------

def _chain(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("hash"))
    honest = F.lag("hash", 1, logs.GENESIS).over(w)
    return e.withColumn("prev_hash", F.when(F.col("event_id") % 97 == 0, "tampered").otherwise(honest))


def log_z2_broken(spark: SparkSession, d: str) -> DataFrame:
    return logs.broken_links(_chain(spark, d), "user_id", "event_id")


def log_z1_chain(spark: SparkSession, d: str) -> DataFrame:
    return logs.append_chain(table(spark, d, "events"), "user_id", "event_id", ["event_id", "event_type", "props"]).select("user_id", "event_id", "hash")


def log_z9_limited(spark: SparkSession, d: str) -> DataFrame:
    return logs.limited(table(spark, d, "events"), "user_id", "event_id", "value", 200.0).groupBy("user_id").agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_refused"))


QUERIES = {f.__name__: f for f in (
    graph_g1_components, graph_g3_degree, graph_g5_pagerank, graph_g6_closure, graph_g8_levels, graph_g9_paths, graph_g12_crossing, graph_g13_induced, graph_g19_junctions, graph_a23_counts,
    stat_m2_anomalies, stat_m3_covariance, stat_m5_diagonal, stat_m8_one_class, stat_m12_entropy, stat_m13_spectrum, stat_m15_pooling, stat_m21_similar, stat_a18_summary, risk_r3_levels, risk_r6_hash,
    comb_e3_scores, comb_a16_summary, comb_e5_ensemble, comb_e6_dedupe, comb_e7_consensus, eval_v1_confusion, eval_a22_per_cwe, eval_v4_matrix, eval_j17_greedy, log_z2_broken, log_z1_chain, log_z9_limited,
)}

_STEPS = "e AS (SELECT * FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
#: Five event types: no shortest path or shortest circle among them has more than five steps.
_DISTINCT = f"{_STEPS}, s AS (SELECT DISTINCT src, dst FROM e)"
_RANKS = "n AS (SELECT count(*)::double AS n FROM (SELECT src FROM e UNION SELECT dst FROM e)), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), o AS (SELECT src, count(*) AS o FROM e GROUP BY src), w AS (SELECT e.src, e.dst, count(*)::double / any_value(o.o) AS share FROM e JOIN o ON o.src = e.src GROUP BY 1, 2), r0 AS (SELECT id, 1 / n AS rank FROM v, n)"
_CONFQ = "CASE lower(confidence) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.1 END"
_RANKQ = "CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_COMB = f"m AS (SELECT lower(rule_id) AS rule, CASE engine WHEN 'semgrep' THEN 'pattern' WHEN 'dfg' THEN 'statistical' ELSE 'ml' END AS method, {_CONFQ} AS confidence, raw_id FROM raw_findings), c AS (SELECT rule, coalesce(arg_max(confidence, raw_id) FILTER (WHERE method = 'pattern'), 0)::double AS pattern, coalesce(arg_max(confidence, raw_id) FILTER (WHERE method = 'statistical'), 0)::double AS statistical, coalesce(arg_max(confidence, raw_id) FILTER (WHERE method = 'ml'), 0)::double AS ml, array_to_string(list_sort(list_distinct(list(method))), '+') AS methods FROM m GROUP BY rule)"
_HIT = r"coalesce(regexp_matches(code, '(?i)strcpy|sprintf|eval\(|system\(|md5|exec\('), false)"


def _confusion(keys: str, where: str = "") -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""WITH t AS (SELECT {lead}label = 1 AS t, {_HIT} AS p FROM training_samples {where}), n AS (SELECT {lead}count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM t {group}),
 r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::double / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp::double / (tp + fn) ELSE 0 END AS re FROM n)
 SELECT {lead}tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN fp + tn > 0 THEN fp::double / (fp + tn) ELSE 0 END, 6) AS fpr, round((tp + tn)::double / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM r"""


SQL = {
    "graph_g1_components": "WITH m AS (SELECT c_nationkey, least(min('c' || c_custkey), min('n' || c_nationkey)) AS component FROM customer GROUP BY 1) SELECT 'c' || c_custkey AS id, component FROM customer JOIN m USING (c_nationkey) UNION ALL SELECT 'n' || c_nationkey, component FROM m",
    "graph_g3_degree": "WITH e AS (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem) SELECT id, count(*) AS degree, count(*) FILTER (WHERE i) AS n_in, count(*) FILTER (WHERE NOT i) AS n_out FROM (SELECT src AS id, false AS i FROM e UNION ALL SELECT dst, true FROM e) GROUP BY id",
    "graph_g5_pagerank": f"WITH RECURSIVE {_STEPS}, {_RANKS}, it AS (SELECT 0 AS k, id, rank FROM r0 UNION ALL SELECT g.k, v.id, 0.15 / n.n + 0.85 * g.got FROM (SELECT it.k + 1 AS k, w.dst, sum(it.rank * w.share) AS got FROM it JOIN w ON w.src = it.id WHERE it.k < 100 GROUP BY 1, 2) g JOIN v ON v.id = g.dst CROSS JOIN n) SELECT id, round(rank, 6) AS rank FROM it WHERE k = 100",
    "graph_g6_closure": f"WITH RECURSIVE {_DISTINCT}, c AS (SELECT src, dst, 1 AS hops FROM s UNION SELECT c.src, s.dst, hops + 1 FROM c JOIN s ON s.src = c.dst WHERE hops < 6) SELECT src, dst, min(hops) AS hops FROM c GROUP BY 1, 2",
    "graph_g8_levels": f"WITH RECURSIVE {_DISTINCT}, c AS (SELECT unnest(['click', 'error']) AS id, 0 AS level UNION SELECT s.dst, level + 1 FROM c JOIN s ON s.src = c.id WHERE level < 6) SELECT id, min(level) AS level FROM c GROUP BY 1",
    "graph_g9_paths": f"WITH RECURSIVE {_STEPS}, s AS (SELECT DISTINCT src, dst FROM e), p AS (SELECT ['click'] AS path, 'click' AS last UNION ALL SELECT list_append(path, dst), dst FROM p JOIN s ON s.src = p.last WHERE NOT list_contains(path, dst) AND len(path) < 10) SELECT array_to_string(path, '>') AS path FROM p WHERE len(path) > 1",
    "graph_g12_crossing": f"WITH {_STEPS} SELECT src, dst, count(*) AS n FROM e WHERE (src IN ('click', 'view') AND dst = 'error') OR (src = 'error' AND dst IN ('click', 'view')) GROUP BY 1, 2",
    "graph_g13_induced": f"WITH {_STEPS} SELECT src, dst, count(*) AS n FROM e WHERE src IN ('click', 'view', 'error') AND dst IN ('click', 'view', 'error') GROUP BY 1, 2",
    "graph_g19_junctions": f"WITH {_STEPS}, d AS (SELECT id, count(*) FILTER (WHERE i) AS a, count(*) FILTER (WHERE NOT i) AS b FROM (SELECT src AS id, false AS i FROM e UNION ALL SELECT dst, true FROM e) GROUP BY id) SELECT id, CASE WHEN b >= 2 THEN 'stable' ELSE 'unstable' END AS kind, round(a::double / greatest(b, 1), 6) AS ratio FROM d WHERE a >= 2 AND b >= 1",
    "graph_a23_counts": f"WITH {_STEPS} SELECT src, dst, count(*) AS n FROM e GROUP BY 1, 2",
    "stat_m2_anomalies": "WITH m AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1), z AS (SELECT event_id, CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS z FROM events JOIN m USING (event_type)) SELECT event_id, round(z, 5) AS z FROM z WHERE abs(z) > 2",
    "stat_m3_covariance": "SELECT a, b, round(cov, 5) AS cov FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) AS cov FROM lineitem" for a, b in (("l_quantity", "l_quantity"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_discount", "l_discount"), ("l_discount", "l_tax"), ("l_tax", "l_tax"))) + ")",
    "stat_m5_diagonal": "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS m{k}, var_samp({c}) AS v{k}" for k, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))) + " FROM lineitem), q AS (SELECT l_orderkey, l_linenumber, sqrt(" + " + ".join(f"({c} - m{k}) * ({c} - m{k}) / v{k}" for k, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))) + ") AS q FROM lineitem, m) SELECT l_orderkey, l_linenumber, round(q, 4) AS distance FROM q WHERE q > 3",
    "stat_m8_one_class": "WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::double AS x FROM embeddings), c AS (SELECT k, avg(x) AS m FROM x GROUP BY k), q AS (SELECT vec_id, sqrt(sum((x - m) * (x - m))) AS q FROM x JOIN c USING (k) GROUP BY vec_id) SELECT vec_id, round(q / max(q) OVER (), 5) AS score FROM q",
    "stat_m12_entropy": "WITH c AS (SELECT provider, model, count(*)::double AS c FROM usage_events WHERE provider IS NOT NULL GROUP BY 1, 2), t AS (SELECT provider, sum(c) AS n, sum(c * log2(c)) AS l FROM c GROUP BY 1) SELECT provider, round(log2(n) - l / n, 6) AS h, round(CASE WHEN n > 1 THEN (log2(n) - l / n) / log2(n) ELSE 0 END, 6) AS h_normal FROM t",
    "stat_m13_spectrum": "WITH s AS (SELECT hour(ts) AS t, count(*)::double AS x FROM events GROUP BY 1), f AS (SELECT k, sum(x * cos(2 * pi() * k * t / 24)) AS re, sum(x * sin(2 * pi() * k * t / 24)) AS im FROM s, range(1, 12) r(k) GROUP BY k), a AS (SELECT k, 24.0 / k AS period, sqrt(re * re + im * im) / 24 AS amplitude FROM f) SELECT k, round(period::double, 5) AS period, round(amplitude, 4) AS amplitude FROM a WHERE amplitude > 0.5 AND period > 1 AND period < 24",
    "stat_m15_pooling": "SELECT label, k - 1 AS dim, round(avg(x), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::double AS x FROM embeddings) GROUP BY 1, 2",
    "stat_m21_similar": "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) AS c FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS n FROM p WHERE c >= 0.3) SELECT query_id, id, round(c, 4) AS cosine FROM r WHERE n <= 5",
    "stat_a18_summary": "SELECT l_returnflag, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.75), 6) AS q75, round(avg(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS high_ratio FROM (SELECT l_returnflag, l_discount * 10 AS v FROM lineitem) GROUP BY 1",
    "risk_r3_levels": "WITH s AS (SELECT l_discount * 10 AS s FROM lineitem) SELECT CASE WHEN s < 0.25 THEN 'LOW' WHEN s < 0.5 THEN 'MEDIUM' WHEN s < 0.85 THEN 'HIGH' ELSE 'CRITICAL' END AS by_score, CASE WHEN s >= 0.85 THEN 'CRITICAL' WHEN s >= 0.75 THEN 'HIGH' WHEN s >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS by_threshold, count(*) AS n FROM s GROUP BY 1, 2",
    "risk_r6_hash": "SELECT file_path, list_reduce(list_prepend(5381::bigint, list_transform(string_split(file_path, ''), lambda c: ord(c)::bigint)), lambda a, b: (a * 33 + b) & 2147483647) % 10000 AS bucket FROM (SELECT DISTINCT file_path FROM raw_findings)",
    "comb_e3_scores": f"WITH {_COMB} SELECT rule, pattern, statistical, ml, round(pattern * 0.3 + statistical * 0.3 + ml * 0.4, 6) AS combined, round((pattern + statistical + ml) / 3, 6) AS confidence, methods FROM c",
    "comb_a16_summary": f"WITH {_COMB}, a AS (SELECT coalesce(avg(pattern) FILTER (WHERE pattern > 0), 0) AS p, coalesce(avg(statistical) FILTER (WHERE statistical > 0), 0) AS s, coalesce(avg(ml) FILTER (WHERE ml > 0), 0) AS m, avg((pattern + statistical + ml) / 3) AS c FROM c) SELECT round(p, 6) AS pattern, round(s, 6) AS statistical, round(m, 6) AS ml, round(c, 6) AS confidence, round(p * 0.3 + s * 0.3 + m * 0.4, 6) AS overall FROM a",
    "comb_e5_ensemble": f"WITH r AS (SELECT file_path AS file, lower(rule_id) AS rule, start_line AS line, engine, {_CONFQ}::double AS c, {_RANKQ} AS k, CASE WHEN engine IN ('semgrep', 'dfg') THEN 0.3 ELSE 0.2 END::double AS w FROM raw_findings) SELECT file, rule, line, round(sum(c * w) / sum(w), 6) AS confidence, max(k) AS rank, count(DISTINCT engine) AS n_sources FROM r GROUP BY 1, 2, 3 HAVING round(sum(c * w) / sum(w), 9) >= 0.3",
    "comb_e6_dedupe": f"SELECT min(raw_id) AS first_id, max({_RANKQ}) AS rank, arg_min(cwe_ids[1], raw_id) FILTER (WHERE len(cwe_ids) > 0) AS cwe FROM raw_findings GROUP BY scan_run_id, rule_id, file_path, start_line",
    "comb_e7_consensus": f"WITH r AS (SELECT scan_run_id, file_path, lower(rule_id) AS rule, start_line AS line, raw_id, {_RANKQ} AS k, engine FROM raw_findings), p AS (SELECT a.raw_id AS a, min(b.raw_id) AS b FROM r a JOIN r b ON a.engine = 'semgrep' AND b.engine <> 'semgrep' AND a.scan_run_id = b.scan_run_id AND a.file_path = b.file_path AND a.rule = b.rule AND abs(a.line - b.line) <= 3 GROUP BY 1), m AS (SELECT p.a, p.b, CASE WHEN abs(x.k - y.k) > 1 THEN 'disputed' ELSE 'confirmed' END AS status FROM p JOIN r x ON x.raw_id = p.a JOIN r y ON y.raw_id = p.b) SELECT * FROM m UNION ALL SELECT raw_id, NULL, 'only-a' FROM r WHERE engine = 'semgrep' AND raw_id NOT IN (SELECT a FROM m) UNION ALL SELECT NULL, raw_id, 'only-b' FROM r WHERE engine <> 'semgrep' AND raw_id NOT IN (SELECT b FROM m)",
    "eval_v1_confusion": _confusion(""),
    "eval_a22_per_cwe": _confusion("vulnerability_type", "WHERE vulnerability_type IS NOT NULL"),
    "eval_v4_matrix": "SELECT engine, " + ", ".join(f"count(*) FILTER (WHERE lower(severity) = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")) + " FROM raw_findings GROUP BY engine",
    # chains and running totals entry by entry, all users side by side
    "log_z1_chain": "WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), c AS (SELECT user_id, event_id, k, sha256('0|' || event_id || '|' || event_type || '|' || coalesce(props, '')) AS hash FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, o.k, sha256(c.hash || '|' || o.event_id || '|' || o.event_type || '|' || coalesce(o.props, '')) FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1) SELECT user_id, event_id, hash FROM c",
    "log_z9_limited": "WITH RECURSIVE o AS (SELECT *, coalesce(value, 0) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), c AS (SELECT user_id, k, x <= 200 AS ok, CASE WHEN x <= 200 THEN x ELSE 0 END AS total FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, c.total + o.x <= 200, CASE WHEN c.total + o.x <= 200 THEN c.total + o.x ELSE c.total END FROM c JOIN o ON o.user_id = c.user_id AND o.k = c.k + 1) SELECT user_id, count(*) FILTER (WHERE ok) AS n_accepted, count(*) FILTER (WHERE NOT ok) AS n_refused FROM c GROUP BY 1",
    "log_z2_broken": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events QUALIFY event_id % 97 = 0",
}
