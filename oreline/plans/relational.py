"""Filters, joins, aggregates and windows of the service's reports over the test tables.

The queries are Spark SQL where the service's own are SQL, else the operators of ``oreline.operators.relational``. ``NOW`` stands
for a fixed instant, so that results can be compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import relational as R
from oreline.session import table

NOW = "2026-03-01 00:00:00"
TABLES = ("usage_events", "projects", "targets", "scan_runs", "raw_findings", "findings", "poc_runs", "training_samples", "documents", "events", "customer", "orders", "lineitem", "nation", "region", "supplier", "part")

#: Latest row of each id, as a common table expression.
_LATEST = "{v} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, status, created_at) AS rn FROM {t}) WHERE rn = 1)"
_F, _P, _S, _T, _R = (_LATEST.format(v=v, t=t) for v, t in (("f", "findings"), ("p", "projects"), ("s", "scan_runs"), ("t", "targets"), ("r", "poc_runs")))
_RANK = "CASE lower(f.severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

SPARK = {"ts": "try_cast(ts AS timestamp)", "iso": r"ts RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}T'", "day": "date_format({0}, 'yyyy-MM-dd')", "month": "date_format({0}, 'yyyy-MM')", "us": "unix_micros({0})", "now": f"timestamp'{NOW}'", "has": "array_contains({0}, {1})", "len": "size({0})", "ilike": "{0} ILIKE {1}", "dec": "decimal(20,6)", "hours": "make_dt_interval(0, {0}, 0, 0)", "esc": "\\\\"}
DUCK = {"ts": "try_cast(ts AS timestamptz)", "iso": r"regexp_matches(ts, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T')", "day": "strftime({0} AT TIME ZONE 'UTC', '%Y-%m-%d')", "month": "strftime({0} AT TIME ZONE 'UTC', '%Y-%m')", "us": "epoch_us({0})", "now": f"timestamptz '{NOW}+00'", "has": "list_contains({0}, {1})", "len": "len({0})", "ilike": "{0} ILIKE {1}", "dec": "decimal(20,6)", "hours": "to_hours({0})", "esc": "\\"}


def render(text: str, dialect: dict[str, str]) -> str:
    """Fill ``<<name:argument:...>>`` with the dialect's form."""
    while "<<" in text:
        text = re.sub(r"<<(\w+)((?::[^<>]*)?)>>", lambda m: _form(dialect[m[1]], m[2][1:].split(":") if m[2] else []), text)
    return text


def _form(text: str, args: list[str]) -> str:
    for k, a in enumerate(args):
        text = text.replace("{%d}" % k, a)
    return text


_U = "u AS (SELECT *, <<ts>> AS moment, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS tokens FROM usage_events WHERE <<iso>> AND <<ts>> IS NOT NULL)"

TEXTS: dict[str, str] = {
    # predicates and projections
    "sel_p01_filter": f"WITH {_F} SELECT id, severity, status FROM f WHERE tenant_id = (SELECT max(tenant_id) FROM f) AND severity IN ('critical', 'high') AND status = 'open'",
    "sel_p02_ilike": f"WITH {_F} SELECT id FROM f WHERE title ILIKE '%redirect%' OR file_path ILIKE '%session%'",
    "sel_p03_membership": f"WITH {_F} SELECT id, rule_id FROM f WHERE status NOT IN ('fixed', 'false_positive') AND <<has:engines:'semgrep'>>",
    "sel_p04_time": f"WITH {_F} SELECT id, CASE WHEN created_at >= <<now>> - interval '30' day THEN 'recent' ELSE 'month' END AS why FROM f WHERE created_at >= <<now>> - interval '30' day OR <<month:created_at>> = '2025-12'",
    "sel_p05_not_deleted": f"WITH {_P} SELECT id, name FROM p WHERE deleted_at IS NULL",
    "sel_p06_default": f"WITH {_P} SELECT id, coalesce(default_branch, 'main') AS branch FROM p",
    "sel_p07_rank": f"WITH {_F} SELECT id, {_RANK} AS sev_rank FROM f",
    "sel_p08_round": f"WITH {_U} SELECT capability, CAST(round(CAST(sum(CAST(coalesce(cost_usd, 0) AS <<dec>>)) AS <<dec>>), 6) AS double) AS cost FROM u GROUP BY capability",
    "sel_p09_threshold": f"WITH {_F} SELECT id FROM f WHERE {_RANK} >= 3",
    "sel_p10_confidence": "SELECT raw_id FROM raw_findings WHERE CASE lower(confidence) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0 END >= 0.6",
    "sel_p11_score": "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 100 >= 5 THEN l_discount * 100 ELSE l_tax * 100 END AS score FROM lineitem WHERE CASE WHEN l_discount * 100 >= 5 THEN l_discount * 100 ELSE l_tax * 100 END >= 6",
    "sel_p14_themes": f"WITH {_P}, base AS (SELECT tenant_id, max(sla_tier) AS tier FROM p GROUP BY tenant_id), own AS (SELECT customer_id, tenant_id, max(default_branch) AS branch, max(CASE WHEN status = 'active' THEN sla_tier END) AS tier FROM p GROUP BY customer_id, tenant_id) SELECT o.customer_id, o.tenant_id, coalesce(o.tier, b.tier, 'standard') AS tier, coalesce(o.branch, 'main') AS branch FROM own o LEFT JOIN base b ON b.tenant_id = o.tenant_id",
    # joins
    "join_j01_dimensions": f"WITH {_F}, {_P} SELECT f.id, p.name AS project_name, f.severity, {_RANK} AS sev_rank FROM f JOIN p ON p.id = f.project_id",
    "join_j02_detail": f"WITH {_F}, {_P}, {_S} SELECT f.id, p.slug, s.trigger_type, f.rule_id FROM f JOIN p ON p.id = f.project_id JOIN s ON s.id = f.scan_run_id AND s.project_id = p.id",
    "join_j03_left_default": f"WITH {_U}, {_S} SELECT coalesce(s.customer_id, 'Provider-direct') AS customer, count(*) AS n, sum(u.tokens) AS tokens FROM u LEFT JOIN s ON s.id = u.scan_id GROUP BY coalesce(s.customer_id, 'Provider-direct')",
    "join_j04_lateral_counts": f"WITH {_P}, {_R}, n AS (SELECT project_id, count(*) AS cnt, count(*) FILTER (WHERE exploit_proven) AS proven FROM r GROUP BY project_id) SELECT p.id, coalesce(n.cnt, 0) AS poc_total, coalesce(n.proven, 0) AS poc_proven FROM p LEFT JOIN n ON n.project_id = p.id",
    "join_j05_latest": f"WITH {_P}, {_S}, l AS (SELECT * FROM (SELECT project_id, id, status, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) AS n FROM s) WHERE n = 1) SELECT p.id, l.id AS run_id, l.status AS run_status FROM p LEFT JOIN l ON l.project_id = p.id",
    "join_j06_scalars": f"WITH {_P}, {_S}, n AS (SELECT project_id, count(*) AS n, max(created_at) AS last FROM s GROUP BY project_id) SELECT p.id, coalesce(n.n, 0) AS n_runs, <<us:n.last>> AS last_us FROM p LEFT JOIN n ON n.project_id = p.id",
    "join_j07_exists": f"WITH {_F}, {_R} SELECT f.id, EXISTS (SELECT 1 FROM r WHERE r.finding_id = f.id AND r.exploit_proven) AS proven FROM f",
    "join_j08_scoped": f"WITH {_P}, pol AS (SELECT id AS scope_id, 3 AS prio, sla_tier FROM p WHERE sla_tier <> 'standard' UNION ALL SELECT customer_id, 2, min(sla_tier) FROM p GROUP BY customer_id UNION ALL SELECT tenant_id, 1, min(sla_tier) FROM p GROUP BY tenant_id), c AS (SELECT p.id, pol.prio, pol.sla_tier FROM p JOIN pol ON pol.scope_id = p.id UNION ALL SELECT p.id, pol.prio, pol.sla_tier FROM p JOIN pol ON pol.scope_id = p.customer_id UNION ALL SELECT p.id, pol.prio, pol.sla_tier FROM p JOIN pol ON pol.scope_id = p.tenant_id) SELECT id, sla_tier, prio FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio DESC, sla_tier) AS n FROM c) WHERE n = 1",
    "join_j09_dual_scope": f"WITH {_T}, {_P} SELECT p.id, t.id AS target_id FROM p JOIN t ON t.project_id = p.id UNION ALL SELECT p.id, t.id AS target_id FROM p JOIN t ON t.tenant_id = p.tenant_id AND t.project_id IS NULL",
    "join_j10_baseline": "WITH k AS (SELECT DISTINCT file_path, start_line, lower(rule_id) AS rule FROM raw_findings WHERE engine = 'semgrep'), b AS (SELECT DISTINCT file_path, start_line, lower(rule_id) AS rule FROM raw_findings WHERE engine = 'dfg') SELECT k.* FROM k LEFT ANTI JOIN b ON b.file_path = k.file_path AND b.start_line = k.start_line AND b.rule = k.rule",
    "join_j11_visible": f"WITH {_F}, raw AS (SELECT DISTINCT scan_run_id, lower(rule_id) AS rule, file_path, start_line FROM raw_findings) SELECT raw.scan_run_id, raw.rule, raw.file_path, raw.start_line, coalesce(f.status, 'open') AS status FROM raw LEFT JOIN f ON f.scan_run_id = raw.scan_run_id AND f.rule_id = raw.rule AND f.file_path = raw.file_path AND f.start_line = raw.start_line WHERE coalesce(f.status, 'open') IN ('open', 'confirmed')",
    "join_j12_verification": f"WITH {_F}, {_R}, v AS (SELECT * FROM (SELECT finding_id, exploit_proven, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, id DESC) AS n FROM r) WHERE n = 1) SELECT f.id, CASE WHEN v.finding_id IS NULL THEN 'unverified' WHEN v.exploit_proven THEN 'proven' ELSE 'refuted' END AS mark FROM f LEFT JOIN v ON v.finding_id = f.id",
    "join_j27_proof_flag": f"WITH {_F}, {_R}, v AS (SELECT DISTINCT finding_id FROM r WHERE exploit_proven) SELECT f.id, f.title, v.finding_id IS NOT NULL AS proven, {_RANK} AS sev_rank FROM f LEFT JOIN v ON v.finding_id = f.id ORDER BY sev_rank DESC, f.id LIMIT 200",
    "join_j28_two_lefts": f"WITH {_F}, {_P}, {_S} SELECT f.id, p.name AS project_name, s.status AS run_status FROM f LEFT JOIN p ON p.id = f.project_id LEFT JOIN s ON s.id = f.scan_run_id",
    "join_j29_queue": f"WITH {_S}, {_P} SELECT s.id, p.name AS project_name, s.status FROM s LEFT JOIN p ON p.id = s.project_id WHERE s.status IN ('queued', 'running') ORDER BY s.created_at DESC, s.id LIMIT 100",
    "join_j30_newest": f"WITH {_S} SELECT project_id, id FROM (SELECT project_id, id, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC NULLS LAST, id) AS n FROM s WHERE status = 'done') WHERE n = 1",
    "join_j31_lookup": f"WITH {_T}, {_P} SELECT t.id, t.target_type, p.slug FROM t LEFT JOIN p ON p.id = t.project_id",
    # aggregates
    "agg_a01_summary": f"WITH {_F}, {_P} SELECT f.customer_id, f.project_id, p.name AS project_name, count(*) AS total, count(*) FILTER (WHERE f.status = 'open') AS open_count, count(*) FILTER (WHERE f.status IN ('closed', 'fixed', 'false_positive')) AS closed_count, count(*) FILTER (WHERE f.severity = 'critical') AS critical, count(*) FILTER (WHERE f.severity = 'high') AS high, count(*) FILTER (WHERE f.severity = 'medium') AS medium, count(*) FILTER (WHERE f.severity = 'low') AS low, <<us:max(f.created_at)>> AS last_us FROM f JOIN p ON p.id = f.project_id GROUP BY f.customer_id, f.project_id, p.name",
    "agg_a02_pairs": f"WITH {_F} SELECT project_id, count(*) FILTER (WHERE status = 'open' AND severity = 'critical') AS open_critical, count(*) FILTER (WHERE status = 'open' AND severity = 'high') AS open_high, count(*) FILTER (WHERE status = 'fixed' AND severity IN ('critical', 'high')) AS fixed_severe FROM f GROUP BY project_id",
    "agg_a03_kpi": f"WITH {_F}, {_S}, {_R}, a AS (SELECT 1 AS one, count(*) AS n_findings, count(*) FILTER (WHERE status = 'open') AS n_open FROM f), b AS (SELECT 1 AS one, count(*) AS n_runs, count(*) FILTER (WHERE status = 'failed') AS n_failed FROM s), c AS (SELECT 1 AS one, count(*) AS n_pocs, count(*) FILTER (WHERE exploit_proven) AS n_proven FROM r) SELECT n_findings, n_open, n_runs, n_failed, n_pocs, n_proven FROM a JOIN b USING (one) JOIN c USING (one)",
    "agg_a04_breakdown": f"WITH {_F} SELECT severity, status, count(*) AS n FROM f GROUP BY severity, status",
    "agg_a05_capability": f"WITH {_U} SELECT lower(trim(capability)) AS capability, count(*) AS n, sum(coalesce(prompt_tokens, 0)) AS prompt, sum(coalesce(completion_tokens, 0)) AS completion, sum(tokens) AS tokens, CAST(sum(CAST(coalesce(cost_usd, 0) AS <<dec>>)) AS double) AS cost FROM u GROUP BY lower(trim(capability))",
    "agg_a06_provider": f"WITH {_U} SELECT provider, model, count(*) AS n, sum(tokens) AS tokens FROM u GROUP BY provider, model",
    "agg_a07_top_scans": f"WITH {_U} SELECT scan_id, sum(tokens) AS tokens FROM u WHERE trim(scan_id) <> '' GROUP BY scan_id ORDER BY tokens DESC, scan_id LIMIT 10",
    "agg_a08_day": f"WITH {_U} SELECT <<day:moment>> AS day, <<month:moment>> AS month, count(*) AS n, sum(tokens) AS tokens FROM u GROUP BY <<day:moment>>, <<month:moment>>",
    "agg_a09_report": f"WITH {_U}, k AS (SELECT CASE WHEN coalesce(scan_id, '') <> '' THEN substring(scan_id, 1, 8) ELSE 'unknown' END AS key, tokens, CAST(coalesce(cost_usd, 0) AS <<dec>>) AS cost FROM u), g AS (SELECT key, count(*) AS n, sum(tokens) AS tokens, sum(cost) AS cost FROM k GROUP BY key) SELECT key, n, tokens, CAST(cost AS double) AS cost, sum(n) OVER () AS total_n, sum(tokens) OVER () AS total_tokens FROM g",
    "agg_a11_quota": f"WITH {_U}, w AS (SELECT CAST(count(*) AS double) AS calls, CAST(sum(tokens) AS double) AS tokens, round(sum(coalesce(cost_usd, 0)), 4) AS cost FROM u WHERE moment >= <<now>> - interval '24' hour AND moment < <<now>>), x AS (SELECT 'tokens' AS kind, tokens AS current, 200000.0 AS lim FROM w UNION ALL SELECT 'cost', cost, 0.0 FROM w UNION ALL SELECT 'calls', calls, 50.0 FROM w) SELECT kind, CAST(current AS double) AS current, CAST(lim AS double) AS lim, round(current / lim * 100, 4) AS percentage, current / lim * 100 >= 100 AS exceeded FROM x WHERE lim > 0 AND current / lim * 100 >= 80",
    "agg_a12_severity": "SELECT count(*) FILTER (WHERE upper(severity) = 'CRITICAL') AS critical, count(*) FILTER (WHERE upper(severity) = 'HIGH') AS high, count(*) FILTER (WHERE upper(severity) = 'MEDIUM') AS medium, count(*) FILTER (WHERE coalesce(upper(severity), '') NOT IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS low FROM raw_findings",
    "agg_a13_statuses": f"WITH {_F}, d AS (SELECT 'open' AS status UNION ALL SELECT 'confirmed' UNION ALL SELECT 'fixed' UNION ALL SELECT 'false_positive' UNION ALL SELECT 'accepted_risk'), n AS (SELECT status, count(*) AS n FROM f GROUP BY status) SELECT d.status, coalesce(n.n, 0) AS n FROM d LEFT JOIN n ON n.status = d.status",
    "agg_a14_outcome": f"WITH {_U} SELECT coalesce(provider, 'unknown') AS provider, CASE WHEN cost_usd IS NULL THEN 'unpriced' WHEN tokens = 0 THEN 'empty' ELSE 'success' END AS outcome, count(*) AS n FROM u GROUP BY coalesce(provider, 'unknown'), CASE WHEN cost_usd IS NULL THEN 'unpriced' WHEN tokens = 0 THEN 'empty' ELSE 'success' END",
    "agg_a17_project_risk": f"WITH {_F} SELECT project_id, round(avg({_RANK} / 4.0), 6) AS mean_score, max({_RANK}) AS worst FROM f GROUP BY project_id",
    "agg_a19_distribution": f"WITH {_F}, d AS (SELECT 0 AS lvl UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5), n AS (SELECT {_RANK} AS lvl, count(*) AS n FROM f GROUP BY {_RANK}) SELECT d.lvl, coalesce(n.n, 0) AS n FROM d LEFT JOIN n ON n.lvl = d.lvl",
    "agg_a24_tenants": "SELECT DISTINCT tenant_id FROM findings",
    "agg_a25_barycentre": "SELECT l_returnflag, CASE WHEN sum(l_quantity) = 0 THEN 0 ELSE round(sum(l_quantity * l_discount) / sum(l_quantity), 6) END AS centre FROM lineitem GROUP BY l_returnflag",
    "agg_a26_customer_kpi": f"WITH {_F}, {_S}, a AS (SELECT customer_id, count(*) FILTER (WHERE status = 'open' AND severity = 'critical') AS open_critical, count(*) FILTER (WHERE status = 'open' AND severity = 'high') AS open_high, count(*) FILTER (WHERE status = 'confirmed') AS confirmed FROM f GROUP BY customer_id), b AS (SELECT customer_id, count(*) AS runs_7d FROM s WHERE created_at >= <<now>> - interval '7' day AND created_at < <<now>> GROUP BY customer_id) SELECT a.customer_id, open_critical, open_high, confirmed, coalesce(runs_7d, 0) AS runs_7d FROM a LEFT JOIN b ON b.customer_id = a.customer_id",
    "agg_a27_daily_30": f"WITH {_U} SELECT <<day:moment>> AS day, sum(tokens) AS tokens, count(*) AS n FROM u WHERE moment >= <<now>> - interval '30' day AND moment < <<now>> GROUP BY <<day:moment>>",
    "agg_a28_month_to_date": f"WITH {_U} SELECT lower(trim(capability)) AS capability, sum(tokens) AS tokens FROM u WHERE <<month:moment>> = '2026-02' GROUP BY lower(trim(capability))",
    "agg_a29_counters": f"WITH {_P}, {_F}, {_S}, a AS (SELECT customer_id, count(*) AS n FROM p GROUP BY customer_id), b AS (SELECT customer_id, count(*) AS n FROM f GROUP BY customer_id), c AS (SELECT customer_id, count(*) AS n FROM s GROUP BY customer_id) SELECT a.customer_id, a.n AS n_projects, coalesce(b.n, 0) AS n_findings, coalesce(c.n, 0) AS n_runs FROM a LEFT JOIN b ON b.customer_id = a.customer_id LEFT JOIN c ON c.customer_id = a.customer_id",
    "agg_a30_grand_total": f"WITH {_U} SELECT count(*) AS n, coalesce(sum(tokens), 0) AS tokens FROM u WHERE moment >= <<now>> - interval '90' day AND moment < <<now>>",
    "agg_a31_deliveries": f"WITH {_R} SELECT target_id, count(*) FILTER (WHERE status = 'success') AS ok, count(*) FILTER (WHERE status = 'failed') AS failed, <<us:max(finished_at)>> AS last_us FROM r WHERE trim(target_id) <> '' GROUP BY target_id",
    # order and limits
    "ord_o1_multi_key": f"WITH {_F} SELECT id, {_RANK} AS sev_rank, <<us:last_seen_at>> AS seen_us, row_number() OVER (PARTITION BY tenant_id ORDER BY {_RANK} DESC, last_seen_at DESC NULLS LAST, id) AS place FROM f",
    "ord_o2_page": f"WITH {_F} SELECT id, severity FROM f ORDER BY created_at DESC, id LIMIT 20 OFFSET 40",
    "ord_o3_top": "SELECT engine, raw_id FROM (SELECT engine, raw_id, row_number() OVER (PARTITION BY engine ORDER BY start_line DESC, raw_id) AS n FROM raw_findings) WHERE n <= 5",
    "ord_o4_queue": f"WITH {_S}, {_P}, q AS (SELECT s.id, s.tenant_id, s.created_at, CASE p.sla_tier WHEN 'enterprise' THEN 0 WHEN 'priority' THEN 1 ELSE 2 END + CASE s.trigger_type WHEN 'manual' THEN 0 ELSE 3 END AS prio FROM s JOIN p ON p.id = s.project_id WHERE s.status IN ('queued', 'running')), k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY prio, created_at, id) AS n FROM q) SELECT id, prio FROM k WHERE n <= 2 ORDER BY prio, created_at, id LIMIT 4",
    # sets
    "set_u1_keep_first": "SELECT raw_id FROM (SELECT raw_id, row_number() OVER (PARTITION BY scan_run_id, lower(rule_id), file_path, start_line ORDER BY CASE engine WHEN 'dfg' THEN 0 WHEN 'semgrep' THEN 1 ELSE 2 END, raw_id) AS n FROM raw_findings) WHERE n = 1",
    "set_u2_last_wins": "SELECT raw_id, engine FROM (SELECT raw_id, engine, row_number() OVER (PARTITION BY lower(rule_id), engine ORDER BY raw_id DESC) AS n FROM raw_findings) WHERE n = 1",
    "set_u4_minus": "WITH a AS (SELECT raw_id, lower(rule_id) AS rule, start_line, file_path FROM raw_findings WHERE engine = 'dfg'), b AS (SELECT raw_id, lower(rule_id) AS rule, start_line, file_path FROM raw_findings WHERE engine <> 'dfg') SELECT raw_id FROM a UNION ALL SELECT b.raw_id FROM b LEFT ANTI JOIN a ON a.rule = b.rule AND a.start_line = b.start_line AND a.file_path = b.file_path",
    # windows
    "win_w2_best": "SELECT scan_run_id, rule, raw_id FROM (SELECT scan_run_id, lower(rule_id) AS rule, raw_id, row_number() OVER (PARTITION BY scan_run_id, lower(rule_id) ORDER BY CASE lower(confidence) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END DESC, raw_id) AS n FROM raw_findings) WHERE n = 1",
    "win_w3_best_two_keys": f"WITH {_F} SELECT project_id, file_path, id FROM (SELECT project_id, file_path, id, row_number() OVER (PARTITION BY project_id, file_path ORDER BY CASE lower(confidence) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, {_RANK} DESC, id) AS n FROM f) WHERE n = 1",
    "win_w4_keep_first": "SELECT raw_id FROM (SELECT raw_id, row_number() OVER (PARTITION BY scan_run_id, file_path, start_line ORDER BY raw_id) AS n FROM raw_findings) WHERE n = 1",
    "win_w10_rolling_quota": f"WITH {_U}, e AS (SELECT provider, <<us:moment>> AS us, sum(tokens) AS tokens FROM u WHERE provider IS NOT NULL GROUP BY provider, <<us:moment>>) SELECT provider, us, sum(tokens) OVER (PARTITION BY provider ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS tokens_24h FROM e",
    "log_z11_retention": f"WITH {_P} SELECT <<month:deleted_at>> AS month, count(*) AS n, count(*) FILTER (WHERE deleted_at < <<now>> - interval '30' day) AS purgeable FROM p WHERE deleted_at IS NOT NULL GROUP BY <<month:deleted_at>>",
    "log_z12_rollup": "WITH e AS (SELECT scan_run_id, engine, bool_or(reported_at IS NULL) AS bad, bool_or(reported_at IS NOT NULL) AS good FROM raw_findings GROUP BY scan_run_id, engine) SELECT scan_run_id, CASE WHEN bool_or(bad) AND NOT bool_or(good) THEN 'failed' WHEN bool_or(bad) THEN 'partial' ELSE 'done' END AS status FROM e GROUP BY scan_run_id",
    "log_z14_depth": f"WITH {_S} SELECT tenant_id, count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'canceled') AS canceled FROM s GROUP BY tenant_id",
    "log_z7_transitions": "SELECT id, status, was FROM (SELECT id, status, lag(status) OVER (PARTITION BY id ORDER BY updated_at, status) AS was FROM (SELECT DISTINCT id, status, updated_at FROM scan_runs)) WHERE was IS NOT NULL AND was <> status",
    "log_z15_health": f"WITH {_U} SELECT provider, model, count(*) AS calls, round(avg(tokens), 4) AS mean_tokens, <<us:max(moment)>> AS last_us FROM u GROUP BY provider, model",
    "chk_s21_domains": f"WITH {_F} SELECT status, status IN ('open', 'confirmed', 'fixed', 'false_positive', 'accepted_risk') AS known, count(*) AS n, count(*) FILTER (WHERE start_line IS NULL OR start_line < 0 OR end_line < start_line) AS bad_lines FROM f GROUP BY status, status IN ('open', 'confirmed', 'fixed', 'false_positive', 'accepted_risk')",
    "chk_s23_paths": "SELECT raw_id FROM raw_findings WHERE NOT (file_path LIKE 'src/%' OR file_path LIKE 'lib/%' OR file_path LIKE 'app/%') OR file_path LIKE '%..%'",
}


def _spark_sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        sql = render(text, SPARK)
        for name in TABLES:
            if re.search(rf"\b{name}\b", sql):
                table(spark, d, name).createOrReplaceTempView(name)
        return spark.sql(sql)

    return query


def sel_p12_comment(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "training_samples").where("code is not null").select("id", F.posexplode(F.split("code", "\n")).alias("line_no", "line"))
    bare = F.ltrim(F.col("line"))
    comment = F.contains("line", F.lit("//")) | bare.startswith("#") | bare.startswith("*") | bare.startswith("/*")
    return lines.groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(comment).alias("n_comment"))


def sel_p13_secured(spark: SparkSession, d: str) -> DataFrame:
    f = R.latest_rows(table(spark, d, "findings").select("id", "updated_at", "tenant_id", "customer_id", "status"))
    tenant = table(spark, d, "findings").agg(F.max("tenant_id")).first()[0]
    return R.where_all(R.secured(f, tenant, role="ProviderViewer"), {"status": ["open", "confirmed"]}).select("id")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "usage_events").where(F.col("ts").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T"))
    u = u.withColumn("moment", F.expr("try_cast(ts AS timestamp)")).where("moment is not null")
    return u.withColumn("tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))


def win_w10_rolling_quota(spark: SparkSession, d: str) -> DataFrame:
    e = _usage(spark, d).where("provider is not null").groupBy("provider", F.unix_micros("moment").alias("us")).agg(F.sum("tokens").alias("tokens"))
    return R.rolling_sum(e, ["provider"], "us", "tokens", 24, "tokens_24h").select("provider", "us", "tokens_24h")


def agg_a09_report(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.coalesce("scan_id", F.lit("")) != "", F.substring("scan_id", 1, 8)).otherwise("unknown")
    g = _usage(spark, d).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.coalesce("cost_usd", F.lit(0)).cast("decimal(20,6)")).cast("double").alias("cost"))
    return R.with_totals(g, {"total_n": "n", "total_tokens": "tokens"})


def log_z6_upsert(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings").select(F.lower("rule_id").alias("rule"), "file_path", "engine", "raw_id")
    old = raw.where("engine = 'dfg'").groupBy("rule", "file_path").agg(F.min("raw_id").alias("raw_id"))
    new = raw.where("engine <> 'dfg'").groupBy("rule", "file_path").agg(F.max("raw_id").alias("raw_id"))
    return R.upsert(old, new, ["rule", "file_path"])


QUERIES = {name: _spark_sql(text) for name, text in TEXTS.items()} | {f.__name__: f for f in (sel_p12_comment, sel_p13_secured, log_z6_upsert, win_w10_rolling_quota, agg_a09_report)}


def _duck(text: str) -> str:
    return render(text, DUCK).replace("LEFT ANTI JOIN", "ANTI JOIN")


SQL = {name: _duck(text) for name, text in TEXTS.items()} | {
    "sel_p12_comment": r"WITH l AS (SELECT id, unnest(string_split(code, chr(10))) AS line FROM training_samples WHERE code IS NOT NULL) SELECT id, count(*) AS n_lines, count(*) FILTER (WHERE contains(line, '//') OR starts_with(ltrim(line), '#') OR starts_with(ltrim(line), '*') OR starts_with(ltrim(line), '/*')) AS n_comment FROM l GROUP BY id",
    "sel_p13_secured": f"WITH h AS (SELECT id, max({{'u': updated_at, 't': tenant_id, 'c': customer_id, 's': status}}) AS h FROM findings GROUP BY id) SELECT id FROM h WHERE h.t = (SELECT max(tenant_id) FROM findings) AND h.s IN ('open', 'confirmed')",
    "log_z6_upsert": "WITH o AS (SELECT lower(rule_id) AS rule, file_path, min(raw_id) AS raw_id FROM raw_findings WHERE engine = 'dfg' GROUP BY ALL), n AS (SELECT lower(rule_id) AS rule, file_path, max(raw_id) AS raw_id FROM raw_findings WHERE engine <> 'dfg' GROUP BY ALL) SELECT coalesce(o.rule, n.rule) AS rule, coalesce(o.file_path, n.file_path) AS file_path, coalesce(n.raw_id, o.raw_id) AS raw_id FROM o FULL JOIN n ON o.rule = n.rule AND o.file_path = n.file_path",
}
