"""Taint paths within a scope and threat models over the findings' snippets, with their SQL. A finding's snippet is the scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import code, threats
from oreline.plans import code as code_plans
from oreline.session import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return code.lines(table(spark, d, "raw_findings"), "raw_id", "code_snippet")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return threats.scoped_paths(code_plans._marks(spark, d), "raw_id")


def taint_x2_calls(spark: SparkSession, d: str) -> DataFrame:
    return threats.calls(_lines(spark, d), "raw_id")


def taint_x5_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).drop("ordinal")


def taint_x7_safety(spark: SparkSession, d: str) -> DataFrame:
    return threats.safe_findings(_paths(spark, d), _lines(spark, d), "raw_id").withColumn("confidence", F.round("confidence", 6))


def taint_x8_enhanced(spark: SparkSession, d: str) -> DataFrame:
    found = threats.enhanced_result(threats.enhanced_paths(code_plans._marks(spark, d), "raw_id"), "raw_id")
    return found.withColumn("confidence", F.round("confidence", 6))


def threat_g20_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return threats.trust_boundaries(_paths(spark, d), "raw_id")


def threat_g22_threats(spark: SparkSession, d: str) -> DataFrame:
    found = threats.threats(_paths(spark, d), "raw_id")
    return found.select("raw_id", "category", "source_type", "sink_type", F.array_join("cwes", ",").alias("cwes"), "owasp", "priority")


def threat_g23_schedule(spark: SparkSession, d: str) -> DataFrame:
    return threats.schedule(threats.threats(_paths(spark, d), "raw_id"), "raw_id")


def agg_a21_assessment(spark: SparkSession, d: str) -> DataFrame:
    return threats.risk_assessment(threats.threats(_paths(spark, d), "raw_id"), "raw_id")


def threat_g24_coverage(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "raw_findings").select("raw_id", F.col("cwe_ids").alias("cwes"))
    return threats.coverage(threats.threats(_paths(spark, d), "raw_id"), reports, "raw_id")


def join_j21_categories(spark: SparkSession, d: str) -> DataFrame:
    paths = _paths(spark, d).groupBy("source_type", "sink_type").agg(F.count(F.lit(1)).alias("n_paths"))
    return paths.join(F.broadcast(threats.stride_rows(spark)), ["source_type", "sink_type"]).select("source_type", "sink_type", "category", "owasp", "n_paths")


def threat_g28_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = _paths(spark, d).select("source_type", "sink_type").distinct()
    held = threats.stride_rows(spark).groupBy("source_type", "sink_type").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return kinds.join(F.broadcast(held), ["source_type", "sink_type"], "left").select("source_type", "sink_type", threats.boundary_type(F.col("source_type"), F.col("sink_type")).alias("type"), F.coalesce("categories", F.lit("")).alias("categories"))


QUERIES = {f.__name__: f for f in (taint_x2_calls, taint_x5_paths, taint_x7_safety, taint_x8_enhanced, threat_g20_boundaries, threat_g22_threats, threat_g23_schedule, agg_a21_assessment, threat_g24_coverage, join_j21_categories, threat_g28_kinds)}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_BASE = rf"""{code_plans._TAINT},
 pr AS (SELECT so.raw_id, so.line_no AS source_line, so.o AS so_o, si.line_no AS sink_line, si.o AS si_o, so.type AS source_type, si.type AS sink_type, so.c::double AS sc, si.c::double AS kc FROM so JOIN si USING (raw_id)),
 cl AS (SELECT pr.*, count(sa.c) AS n_clean, coalesce(product(1 - sa.c::double), 1) AS remains FROM pr LEFT JOIN sa ON sa.raw_id = pr.raw_id AND sa.line_no > source_line AND sa.line_no < sink_line GROUP BY ALL)"""
_SCOPED = f"""{_BASE},
 p AS (SELECT raw_id, source_line, sink_line, source_type, sink_type, n_clean > 0 AS sanitized, CASE WHEN n_clean > 0 THEN 0.4 ELSE 0.85 END::double AS confidence,
   row_number() OVER (PARTITION BY raw_id ORDER BY source_line, so_o, sink_line, si_o) AS ordinal FROM cl WHERE sink_line >= source_line)"""
_STRIDE = "st AS (SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(s)}, {q(t)}, [{', '.join(map(q, w))}], {q(o)}, [{', '.join(map(q, r))}])" for c, s, t, w, o, r in threats.STRIDE) + ") v(category, source_type, sink_type, cwes, owasp, rules))"
_WEIGHT = "CASE category " + " ".join(f"WHEN {q(c)} THEN {w}" for c, w in threats.WEIGHTS.items()) + " ELSE 50 END"
_THREATS = f"""{_SCOPED}, {_STRIDE},
 f1 AS (SELECT raw_id, source_type, sink_type, arg_min(confidence, ordinal) AS confidence, arg_min(sanitized, ordinal) AS sanitized FROM p GROUP BY 1, 2, 3),
 th AS (SELECT raw_id, category, source_type, sink_type, cwes, owasp, rules, floor(greatest(0, least(100, ({_WEIGHT} - CASE WHEN sanitized THEN 30 ELSE 0 END) * confidence)) + 0.5)::int AS priority FROM f1 JOIN st USING (source_type, sink_type))"""
_TYPE = "CASE WHEN source_type IN ('network', 'header', 'cookie') THEN 'network' WHEN source_type IN ('db', 'file_io') THEN 'data_store' WHEN sink_type IN ('sql', 'db') THEN 'data_store' WHEN sink_type = 'network_send' THEN 'output' WHEN sink_type IN ('shell', 'eval', 'dynamic_code') THEN 'process' ELSE 'input' END"
_FACTOR = r"""CASE WHEN regexp_matches(line, 'allow-listed|whitelist|isAllowed|validated') THEN 0.4
  WHEN sink_type = 'shell' AND regexp_matches(wide, 'is_numeric\s*\([^)]*\)') THEN CASE WHEN len(regexp_extract_all(wide, 'is_numeric\s*\(')) >= 3 THEN 0.15 ELSE 0.4 END
  WHEN sink_type IN ('shell', 'sql', 'ssrf') AND regexp_matches(wide, 'intval\s*\([^)]*\)|filter_var\s*\([^,]+,\s*FILTER_VALIDATE_(INT|EMAIL|URL|FLOAT|BOOLEAN)') THEN 0.3
  WHEN sink_type IN ('shell', 'ssrf', 'eval') AND regexp_matches(wide, 'preg_match\s*\(\s*[''"]/[^''"]*[''"]\s*,\s*\$\w+') THEN 0.25
  WHEN sink_type = 'sql' AND regexp_matches(wide, '(?i)mysql_real_escape_string|mysqli_real_escape_string|pg_escape_string|PreparedStatement|\$\w+\s*=\s*[''"][^''"]*[''"]\s*\.\s*\$') THEN 0.3 ELSE 1 END"""
_CALLS = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in threats.CALLS)

SQL = {
    "taint_x2_calls": rf"WITH {code_plans._SNIP}, c AS (SELECT raw_id, line_no, string_split(unnest(regexp_extract_all(line, '([A-Za-z_$][\w$.]*)\s*\(', 1)), '.')[-1] AS callee FROM l) SELECT raw_id, line_no, callee, role, type FROM c JOIN (VALUES {_CALLS}) k(callee, role, type) USING (callee)",
    "taint_x5_paths": f"WITH {_SCOPED} SELECT raw_id, source_line, sink_line, source_type, sink_type, sanitized, confidence FROM p",
    "taint_x7_safety": f"""WITH {_SCOPED}, f1 AS (SELECT raw_id, sink_type, sink_line, arg_min(confidence, ordinal) AS confidence FROM p GROUP BY 1, 2, 3),
 a AS (SELECT raw_id, line_no, line, string_agg(line, chr(10)) OVER (PARTITION BY raw_id ORDER BY line_no ROWS BETWEEN 29 PRECEDING AND 5 FOLLOWING) AS wide FROM l),
 x AS (SELECT f1.raw_id, sink_type, sink_line, round((confidence * {_FACTOR})::double, 6) AS confidence FROM f1 JOIN a ON a.raw_id = f1.raw_id AND a.line_no = sink_line) SELECT * FROM x WHERE confidence >= 0.2""",
    "taint_x8_enhanced": f"WITH {_BASE}, e AS (SELECT raw_id, sc * kc * remains AS c FROM cl WHERE sc * kc * remains > 0.3) SELECT raw_id, count(*) AS n_paths, round(avg(c), 6) AS confidence, false AS inter_procedural FROM e GROUP BY 1",
    "threat_g20_boundaries": f"WITH {_SCOPED} SELECT raw_id, source_type, sink_type, {_TYPE} AS type, arg_min(source_line, ordinal) AS line, arg_min(confidence, ordinal) AS confidence FROM p WHERE confidence >= 0.4 GROUP BY raw_id, source_type, sink_type",
    "threat_g22_threats": f"WITH {_THREATS} SELECT raw_id, category, source_type, sink_type, array_to_string(cwes, ',') AS cwes, owasp, priority FROM th",
    "threat_g23_schedule": f"WITH {_THREATS} SELECT raw_id, category, array_to_string(list_sort(rules), ',') AS rules, max(priority) AS priority FROM th WHERE priority >= 20 GROUP BY 1, 2, 3",
    "agg_a21_assessment": f"WITH {_THREATS} SELECT raw_id, least(100, floor(sum(priority) / 540.0 * 100 + 0.5))::int AS overall, count(*) FILTER (WHERE priority >= 70) AS critical_paths, " + ", ".join(f"least(100, coalesce(sum(priority) FILTER (WHERE category = {q(c)}), 0))::int AS {c}" for c in threats.CATEGORIES) + " FROM th GROUP BY 1",
    "threat_g24_coverage": f"""WITH {_THREATS}, t AS (SELECT th.raw_id, category, coalesce(list_has_any(cwes, r.cwe_ids), false) AS hit FROM th JOIN raw_findings r ON r.raw_id = th.raw_id)
 SELECT raw_id, count(*) AS total, count(*) FILTER (WHERE hit) AS scanned, floor(count(*) FILTER (WHERE hit) / count(*) * 100 + 0.5)::int AS percent,
  array_to_string(list_filter([{', '.join(map(q, threats.CATEGORIES))}], lambda c: NOT list_contains(coalesce(list(DISTINCT category) FILTER (WHERE hit), []), c)), ',') AS unscanned FROM t GROUP BY 1""",
    "join_j21_categories": f"WITH {_SCOPED}, {_STRIDE}, n AS (SELECT source_type, sink_type, count(*) AS n_paths FROM p GROUP BY 1, 2) SELECT source_type, sink_type, category, owasp, n_paths FROM n JOIN st USING (source_type, sink_type)",
    "threat_g28_kinds": f"WITH {_SCOPED}, {_STRIDE}, k AS (SELECT DISTINCT source_type, sink_type FROM p), c AS (SELECT source_type, sink_type, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM st GROUP BY 1, 2) SELECT source_type, sink_type, {_TYPE} AS type, coalesce(categories, '') AS categories FROM k LEFT JOIN c USING (source_type, sink_type)",
}
