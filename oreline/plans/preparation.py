"""Queries p2, p3 and p6 over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import features, orphans, snapshots
from oreline.session import table

REF_FIELDS = {"finding_id": "findings", "target_id": "targets", "project_id": "projects"}


def _long(spark: SparkSession, d: str) -> DataFrame:
    return features.features_long(table(spark, d, "usage_events"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).where("n_events >= 3").select(F.col("entity").alias("scan_id"), F.col("event_type").alias("capability"))


def p2_long(spark: SparkSession, d: str) -> DataFrame:
    return _long(spark, d).select(F.col("entity").alias("scan_id"), F.col("event_type").alias("capability"), "n_events", F.unix_micros("last_at").alias("last_us"), F.round("cost", 6).alias("cost"))


def p2_features(spark: SparkSession, d: str) -> DataFrame:
    wide = features.features_wide(_long(spark, d))
    digits = {"cost_": 6, "age_": 3}
    return wide.select(*(next((F.round(c, k).alias(c) for p, k in digits.items() if c.startswith(p)), F.col(c)) for c in wide.columns))


def _refs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.references(table(spark, d, "poc_runs"), REF_FIELDS)
    held = orphans.parents(table(spark, d, "findings"), "findings")
    held = held.unionByName(orphans.parents(table(spark, d, "targets"), "targets"))
    held = held.unionByName(orphans.parents(table(spark, d, "projects"), "projects", to_col="deleted_at"))
    return refs, held


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    refs, held = _refs(spark, d)
    return orphans.orphans(refs, held).select(F.col("ref_id").alias("poc_run_id"), "ref_field").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    refs, held = _refs(spark, d)
    return orphans.orphan_report(refs, orphans.orphans(refs, held))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "raw_findings"), table(spark, d, "scan_runs"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(p6_found(spark, d), table(spark, d, "scan_runs"))


QUERIES = {f.__name__: f for f in (p2_found, p2_long, p2_features, p3_found, p3_report, p6_found, p6_counts)}

_STRIP = r"regexp_replace({0}, '^[\s\x{{85}}\x{{a0}}]+|[\s\x{{85}}\x{{a0}}]+$', '', 'g')"
_ISO = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?\s?([Zz]|[+-]\d{2}(:?\d{2})?)?$"
_USABLE = f"""
 usable AS (
  SELECT scan_id, lower({_STRIP.format('capability')}) AS capability, request_id, try_cast(ts AS timestamptz) AS moment, received_at, cost_usd
  FROM usage_events
  WHERE regexp_full_match(trim(ts), '{_ISO}') AND try_cast(ts AS timestamptz) IS NOT NULL
    AND {_STRIP.format('scan_id')} <> '' AND {_STRIP.format('capability')} <> '')"""
_AGED = f"""WITH {_USABLE},
 once AS (SELECT scan_id, capability, request_id, max(moment) AS moment, (max({{'k': cost_usd IS NOT NULL, 'r': received_at, 'c': cost_usd}})).c AS cost FROM usable GROUP BY 1, 2, 3),
 long AS (SELECT scan_id, capability, count(request_id) AS n, max(moment) AS last_at, coalesce(sum(CASE WHEN request_id IS NOT NULL THEN cost END), 0) AS cost FROM once GROUP BY 1, 2),
 aged AS (SELECT scan_id, 'T' || regexp_replace(capability, '[^A-Za-z0-9_]', '_', 'g') AS kind, n, cost, epoch_us((SELECT max(last_at) FROM long)) / 1e6 - epoch_us(last_at) / 1e6 AS age FROM long),
 every AS (SELECT * FROM aged UNION ALL SELECT scan_id, 'Aall', n, cost, age FROM aged)"""
_KEY = "nullif(lower(trim({0}, ' {{}}' || chr(9) || chr(10) || chr(13))), '')"
_ORPHANS = f"""
 refs AS (
  SELECT DISTINCT id AS poc_run_id, ref_field, ref_table, key, created_at AS moment FROM (
   SELECT id, created_at, 'finding_id' AS ref_field, 'findings' AS ref_table, {_KEY.format('finding_id')} AS key FROM poc_runs
   UNION ALL SELECT id, created_at, 'target_id', 'targets', {_KEY.format('target_id')} FROM poc_runs
   UNION ALL SELECT id, created_at, 'project_id', 'projects', {_KEY.format('project_id')} FROM poc_runs) WHERE key IS NOT NULL),
 held AS (
  SELECT 'findings' AS ref_table, {_KEY.format('id')} AS key, created_at AS f, NULL::timestamptz AS u FROM findings
  UNION ALL SELECT 'targets', {_KEY.format('id')}, created_at, NULL FROM targets
  UNION ALL SELECT 'projects', {_KEY.format('id')}, created_at, deleted_at FROM projects),
 missed AS (
  SELECT r.* FROM refs r WHERE NOT EXISTS (
   SELECT 1 FROM held h WHERE h.ref_table = r.ref_table AND h.key = r.key AND h.f <= r.moment AND (h.u IS NULL OR h.u > r.moment)))"""
_PATH = r"array_to_string(list_filter(string_split(replace({0}, '\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/')"
_CHANGES = f"""
 held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM scan_runs) WHERE rn = 1),
 snap AS (
  SELECT id, project_id, findings_new, findings_fixed, lag(id) OVER (PARTITION BY project_id ORDER BY started_at, id) AS prev_id
  FROM held WHERE status = 'done' AND incremental_mode = 'full' AND started_at IS NOT NULL AND project_id IS NOT NULL),
 rec AS (
  SELECT scan_run_id, lower(rule_id) AS rule_id, {_PATH.format('file_path')} AS file_path, min(start_line) AS lo, max(start_line) AS hi,
   max(CASE WHEN upper(severity) IN ('CRITICAL', 'ERROR') THEN 4 WHEN upper(severity) IN ('HIGH', 'WARNING') THEN 3 WHEN upper(severity) IN ('MEDIUM', 'INFO') THEN 2 ELSE 1 END) AS sev
  FROM raw_findings GROUP BY ALL),
 later AS (SELECT s.id AS pair, r.* FROM snap s JOIN rec r ON r.scan_run_id = s.id WHERE s.prev_id IS NOT NULL),
 earlier AS (SELECT s.id AS pair, r.* FROM snap s JOIN rec r ON r.scan_run_id = s.prev_id),
 changes AS (
  SELECT coalesce(l.pair, e.pair) AS scan_run_id, coalesce(l.rule_id, e.rule_id) AS rule_id, coalesce(l.file_path, e.file_path) AS file_path,
   CASE WHEN e.pair IS NULL THEN 'added' WHEN l.pair IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
  FROM later l FULL JOIN earlier e ON l.pair = e.pair AND l.rule_id = e.rule_id AND l.file_path = e.file_path
  WHERE l.pair IS NULL OR e.pair IS NULL OR l.lo IS DISTINCT FROM e.lo OR l.hi IS DISTINCT FROM e.hi OR l.sev <> e.sev)"""

SQL = {
    "p2_found": f"WITH {_USABLE} SELECT scan_id, capability FROM usable GROUP BY 1, 2 HAVING count(DISTINCT request_id) >= 3",
    "p2_long": f"""WITH {_USABLE},
 once AS (SELECT scan_id, capability, request_id, max(moment) AS moment, (max({{'k': cost_usd IS NOT NULL, 'r': received_at, 'c': cost_usd}})).c AS cost FROM usable GROUP BY 1, 2, 3)
 SELECT scan_id, capability, count(request_id) AS n_events, epoch_us(max(moment)) AS last_us, round(coalesce(sum(CASE WHEN request_id IS NOT NULL THEN cost END), 0), 6) AS cost FROM once GROUP BY 1, 2""",
    # three pivots, as a pivot's columns are of one type; each reads its rows from a query of its own
    "p2_features": "SELECT *, 0::bigint AS n_other, 0::double AS cost_other, NULL::double AS age_other FROM " + " JOIN ".join(
        f"(SELECT * FROM (PIVOT ({_AGED} SELECT scan_id, '{name}_' || substr(kind, 2) AS c, {name} AS v FROM every) ON c USING {total} GROUP BY scan_id))" + (" USING (scan_id)" if name != "n" else "")
        for name, total in (("n", "coalesce(sum(v), 0)::bigint"), ("cost", "round(coalesce(sum(v), 0), 6)"), ("age", "round(min(v), 3)"))
    ),
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT poc_run_id, ref_field FROM missed",
    "p3_report": f"""WITH {_ORPHANS},
 n AS (SELECT ref_table, strftime(moment AT TIME ZONE 'UTC', '%Y-%m') AS month, count(DISTINCT (poc_run_id, ref_field)) AS n_refs FROM refs GROUP BY 1, 2),
 m AS (SELECT ref_table, strftime(moment AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n_orphans FROM missed GROUP BY 1, 2)
 SELECT n.ref_table, n.month, n_refs, coalesce(n_orphans, 0) AS n_orphans, round(coalesce(n_orphans, 0) / n_refs, 6) AS rate FROM n LEFT JOIN m ON n.ref_table = m.ref_table AND n.month IS NOT DISTINCT FROM m.month""",
    "p6_found": f"WITH {_CHANGES} SELECT * FROM changes",
    "p6_counts": f"""WITH {_CHANGES},
 per AS (SELECT scan_run_id, count(*) FILTER (WHERE change_kind = 'added') AS n_added, count(*) FILTER (WHERE change_kind = 'removed') AS n_removed, count(*) FILTER (WHERE change_kind = 'changed') AS n_changed FROM changes GROUP BY 1)
 SELECT s.id AS scan_run_id, s.project_id, coalesce(n_added, 0) AS n_added, coalesce(n_removed, 0) AS n_removed, coalesce(n_changed, 0) AS n_changed, s.findings_new, s.findings_fixed
 FROM snap s LEFT JOIN per p ON p.scan_run_id = s.id WHERE s.prev_id IS NOT NULL""",
}
