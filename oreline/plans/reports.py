"""Logs, states, catalogues and reports of the service over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oreline.operators import code, reports, rules
from oreline.operators.relational import latest_rows, severity_rank
from oreline.plans import code as code_plans
from oreline.plans.relational import NOW
from oreline.session import table

KNOWN_WEAKNESSES = ("CWE-22", "CWE-78", "CWE-79", "CWE-89", "CWE-117", "CWE-120", "CWE-287", "CWE-327", "CWE-352", "CWE-377", "CWE-434", "CWE-489", "CWE-502", "CWE-601", "CWE-611", "CWE-798", "CWE-862", "CWE-918")
ADAPTERS = ("codeql", "dfg", "semgrep", "trivy")
STATUSES = ("open", "confirmed", "fixed", "false_positive", "accepted_risk")


def src_s07_audit(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_page(table(spark, d, "events"), "event_type", "error", ["ts", "event_id"]).select("event_id", "user_id", "value")


def src_s08_state(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "findings").select(F.col("fingerprint").alias("fp"), "status", F.col("confidence").alias("by"), F.unix_micros("updated_at").alias("us"))
    return reports.triage_state(rows, "fp", "us", STATUSES)


def src_s09_baseline(spark: SparkSession, d: str) -> DataFrame:
    return reports.baseline_keys(table(spark, d, "raw_findings"), "file_path", "start_line", "rule_id")


def log_z5_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "findings").select(F.col("fingerprint").alias("fp"), "status", F.col("confidence").alias("by"), F.unix_micros("updated_at").alias("us"))
    state = reports.triage_state(rows, "fp", "us", STATUSES)
    return reports.clean_state(state, "us", F.lit(NOW).cast("timestamp"), 30, ("fixed", "false_positive"))


def sel_p15_categories(spark: SparkSession, d: str) -> DataFrame:
    hits = code.rule_hits(code.lines(table(spark, d, "raw_findings"), "raw_id", "code_snippet"), "raw_id")
    return hits.groupBy(reports.rule_category(F.col("rule_id")).alias("category"), "severity").agg(F.count(F.lit(1)).alias("n"))


def agg_a15_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = latest_rows(table(spark, d, "poc_runs").select("id", "updated_at", "poc_script", "stdout_log", "exploit_proven", "http_status", "duration_ms"))
    entries = p.select(
        (F.coalesce("duration_ms", F.lit(0)) / 1000).alias("cost"), F.coalesce(F.col("exploit_proven"), F.lit(False)).cast("int").alias("accepted"), (~F.coalesce(F.col("exploit_proven"), F.lit(False))).cast("int").alias("rejected"),
        (code.injection_score(F.coalesce("stdout_log", F.lit(""))) > 0).alias("injection"), (F.col("http_status") == 429).alias("limited"), reports.redactions(F.coalesce("poc_script", F.lit(""))).alias("redactions"),
    )
    out = reports.security_metrics(entries)
    return out.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in out.dtypes))


def rep_a32_projects(spark: SparkSession, d: str) -> DataFrame:
    f = latest_rows(table(spark, d, "findings").select("id", "updated_at", "project_id", "severity", "title", "last_seen_at"))
    return reports.project_report(f, "project_id", "severity", "title", "last_seen_at", "id")


def rep_s16_usage(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "usage_events").where("capability is not null")
    dec = F.coalesce("cost_usd", F.lit(0)).cast("decimal(20,8)")
    g = u.groupBy(F.lower(F.trim("capability")).alias("key")).agg(F.count(F.lit(1)).alias("events"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("completion_tokens"), F.sum(dec).alias("cost_usd"))
    return g.select("key", reports.usage_line().alias("line"))


def rep_v5_ordered(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("scan_run_id").orderBy(severity_rank("severity").desc(), "raw_id")
    return table(spark, d, "raw_findings").where(severity_rank("severity") >= 2).select("scan_run_id", "raw_id", F.row_number().over(w).alias("place"))


def rep_e9_summary(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings").select("scan_run_id", severity_rank("severity").alias("r"), F.lower(F.trim("confidence")).alias("c"))
    return reports.scan_summary(raw, "scan_run_id")


def chk_e11_adapters(spark: SparkSession, d: str) -> DataFrame:
    return reports.skipped_adapters(table(spark, d, "raw_findings").select("scan_run_id", "engine"), "scan_run_id", "engine", ADAPTERS, ("dfg", "semgrep", "trivy"))


def chk_e12_coverage(spark: SparkSession, d: str) -> DataFrame:
    return reports.technique_coverage(table(spark, d, "raw_findings").select("project_id", F.explode("cwe_ids").alias("cwe")), "project_id", "cwe", KNOWN_WEAKNESSES)


def win_w07_fallthrough(spark: SparkSession, d: str) -> DataFrame:
    nodes = code_plans._marks(spark, d).select("raw_id", "line_no")
    return reports.fall_through(nodes, "raw_id", "line_no")


QUERIES = {f.__name__: f for f in (src_s07_audit, src_s08_state, src_s09_baseline, log_z5_clean, sel_p15_categories, agg_a15_metrics, rep_a32_projects, rep_s16_usage, rep_v5_ordered, rep_e9_summary, chk_e11_adapters, chk_e12_coverage, win_w07_fallthrough)}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs) -> str:
    return ", ".join(map(q, xs))


def _redacted() -> str:
    out, last = "r0 AS (SELECT id, coalesce(poc_script, '') AS t, 0 AS n FROM h)", "r0"
    for k, (_, p) in enumerate(rules.SECRETS, 1):
        out += f", r{k} AS (SELECT id, regexp_replace(t, {q(p)}, '***REDACTED***', 'g') AS t, n + len(regexp_extract_all(t, {q(p)})) AS n FROM {last})"
        last = f"r{k}"
    return out + f", red AS (SELECT id, n FROM {last})"


_RANK = "CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
_STATE = f"s AS (SELECT fingerprint AS fp, (max({{'us': epoch_us(updated_at), 'st': status, 'by': coalesce(confidence, 'unknown')}})) AS h FROM findings WHERE fingerprint IS NOT NULL AND updated_at IS NOT NULL AND status IN ({_list(STATUSES)}) GROUP BY 1), st AS (SELECT fp, h.st AS status, h.by AS \"by\", h.us AS us FROM s)"
_INJ = " + ".join(f"CASE WHEN regexp_matches(stdout_log, {q('(?i)' + p)}) THEN {w} ELSE 0 END" for _, w, p in rules.INJECTIONS)

SQL = {
    "src_s07_audit": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 100",
    "src_s08_state": f"WITH {_STATE} SELECT * FROM st",
    "src_s09_baseline": "SELECT DISTINCT coalesce(file_path, '') || ':' || coalesce(start_line::varchar, '') || ':' || coalesce(rule_id, '') AS fp FROM raw_findings",
    "log_z5_clean": f"WITH {_STATE} SELECT * FROM st WHERE NOT (status IN ('fixed', 'false_positive') AND us <= epoch_us(timestamptz '{NOW}+00' - interval '30' day))",
    "sel_p15_categories": f"WITH {code_plans._SNIP} SELECT CASE WHEN split_part(rule_id, '-', 1) IN ({_list(reports.CATEGORIES)}) THEN split_part(rule_id, '-', 1) ELSE 'MEM' END AS category, severity, count(*) AS n FROM l JOIN (VALUES {code_plans._RULES}) r(rule_id, severity, confidence, p) ON regexp_matches(line, p, 'i') GROUP BY 1, 2",
    "agg_a15_metrics": f"""WITH h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM poc_runs WHERE id IS NOT NULL) WHERE rn = 1), {_redacted()},
 m AS (SELECT count(*) AS scans, coalesce(sum({_INJ} > 0), 0) AS attempts, sum(red.n) AS redacted, count(*) FILTER (WHERE exploit_proven) AS accepted, count(*) FILTER (WHERE NOT coalesce(exploit_proven, false)) AS rejected,
   count(*) FILTER (WHERE http_status = 429) AS limited, sum(coalesce(duration_ms, 0) / 1000) AS cost FROM (SELECT * REPLACE (coalesce(stdout_log, '') AS stdout_log) FROM h) h JOIN red USING (id))
 SELECT scans::bigint AS scans, attempts::bigint AS injections, redacted::bigint AS redacted, accepted, rejected, limited, round(cost, 6) AS cost, round(CASE WHEN attempts > 0 THEN accepted / attempts ELSE 0 END, 6) AS per_injection,
  round(CASE WHEN accepted + rejected > 0 THEN rejected / (accepted + rejected) ELSE 0 END, 6) AS rejection_rate, CASE WHEN attempts > scans * 0.1 THEN 'HIGH' WHEN attempts > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM m""",
    "rep_a32_projects": f"""WITH h AS (SELECT * FROM (SELECT *, {_RANK} AS r, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM findings WHERE id IS NOT NULL) WHERE rn = 1),
 o AS (SELECT *, row_number() OVER (PARTITION BY project_id, r >= 3 ORDER BY r DESC, last_seen_at DESC NULLS LAST, id) AS place FROM h)
 SELECT project_id, '| critical | ' || count(*) FILTER (WHERE r = 4) || ' |' || chr(10) || '| high | ' || count(*) FILTER (WHERE r = 3) || ' |' || chr(10) || '| medium | ' || count(*) FILTER (WHERE r = 2) || ' |' || chr(10) || '| low | ' || count(*) FILTER (WHERE r < 2) || ' |'
  || coalesce(string_agg(chr(10) || '- [' || CASE r WHEN 4 THEN 'critical' ELSE 'high' END || '] ' || coalesce(title, ''), '' ORDER BY place) FILTER (WHERE r >= 3 AND place <= 20), '') AS document FROM o GROUP BY 1""",
    "rep_s16_usage": "WITH g AS (SELECT lower(trim(capability)) AS key, count(*) AS n, sum(coalesce(prompt_tokens, 0)) AS p, sum(coalesce(completion_tokens, 0)) AS c, round(sum(coalesce(cost_usd, 0)::decimal(20, 8)), 4)::decimal(20, 4) AS cost FROM usage_events WHERE capability IS NOT NULL GROUP BY 1) SELECT key, '| ' || key || ' | ' || format('{:,}', n::bigint) || ' | ' || format('{:,}', p::bigint) || ' | ' || format('{:,}', c::bigint) || ' | $' || cost::varchar || ' |' AS line FROM g",
    "rep_v5_ordered": f"SELECT scan_run_id, raw_id, row_number() OVER (PARTITION BY scan_run_id ORDER BY {_RANK} DESC, raw_id) AS place FROM raw_findings WHERE {_RANK} >= 2",
    "rep_e9_summary": f"""WITH s AS (SELECT scan_run_id, count(*) AS n, count(*) FILTER (WHERE {_RANK} >= 3) AS severe, count(*) FILTER (WHERE lower(trim(confidence)) = 'high') AS sure FROM raw_findings GROUP BY 1)
 SELECT scan_run_id, 'findings: ' || n || ', severe: ' || severe || ' (' || (floor(severe * 1000 / n + 0.5) / 10)::decimal(9, 1)::varchar || '%), sure: ' || sure AS line FROM s""",
    "chk_e11_adapters": f"""WITH r AS (SELECT DISTINCT scan_run_id FROM raw_findings), a AS (SELECT unnest([{_list(ADAPTERS)}]) AS adapter)
 SELECT r.scan_run_id, a.adapter, CASE WHEN a.adapter IN ('dfg', 'semgrep', 'trivy') THEN 'no-result' ELSE 'unsupported-adapter' END AS reason FROM r, a WHERE NOT EXISTS (SELECT 1 FROM raw_findings f WHERE f.scan_run_id IS NOT DISTINCT FROM r.scan_run_id AND f.engine = a.adapter)""",
    "chk_e12_coverage": f"""WITH e AS (SELECT project_id, unnest(cwe_ids) AS cwe FROM raw_findings), k AS (SELECT DISTINCT project_id, cwe FROM e WHERE cwe IN ({_list(KNOWN_WEAKNESSES)})), p AS (SELECT DISTINCT project_id FROM e)
 SELECT p.project_id, count(k.cwe) AS covered, round(count(k.cwe) * 100.0 / {len(KNOWN_WEAKNESSES)}, 2)::double AS percent, array_to_string(list_filter([{_list(sorted(KNOWN_WEAKNESSES))}], lambda x: NOT list_contains(coalesce(list(k.cwe) FILTER (WHERE k.cwe IS NOT NULL), []), x)), ',') AS uncovered FROM p LEFT JOIN k ON k.project_id IS NOT DISTINCT FROM p.project_id GROUP BY 1""",
    "win_w07_fallthrough": f"WITH {code_plans._TAINT}, m AS (SELECT DISTINCT raw_id, line_no FROM (SELECT raw_id, line_no FROM so UNION ALL SELECT raw_id, line_no FROM si UNION ALL SELECT raw_id, line_no FROM sa)), n AS (SELECT raw_id, line_no AS src, lead(line_no) OVER (PARTITION BY raw_id ORDER BY line_no) AS dst FROM m) SELECT * FROM n WHERE dst = src + 1",
}
