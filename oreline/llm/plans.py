"""Queries of the text problems over the test tables, with SQL where SQL can say them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oreline.llm import chunking, leakage, packing, secrets, survivors, syntax
from oreline.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.find_invalid(table(spark, d, "training_samples")).select("id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, d, "training_samples"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.representatives(table(spark, d, "raw_findings")).select("group_id", "best_id")


def p4_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "raw_findings"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.texts_of(table(spark, d, "raw_findings"), "raw_findings", "raw_id", ("code_snippet",))
    return found.unionByName(secrets.texts_of(table(spark, d, "poc_runs"), "poc_runs", "id", ("poc_script", "stdout_log")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(_texts(spark, d)).select("table_name", "record_id", "field_name").distinct()


def p5_places(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find_secrets(_texts(spark, d)).distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_texts(_texts(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.divided(packing.pack_documents(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack_documents(table(spark, d, "documents")))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    return packing.checked(packing.pack_documents(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_paraphrases(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    return leakage.leak_report(leakage.find_leaks(docs, items), docs, items)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.divided(chunking.split_documents(table(spark, d, "documents")))


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_documents(table(spark, d, "documents"))


def p9_checked(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return chunking.checked(chunking.split_documents(docs), docs)


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p4_found, p4_survivors, p5_found, p5_places, p5_redacted, p7_found, p7_containers, p7_fill, p7_checked, p8_found, p8_paraphrases, p8_report, p9_found, p9_pieces, p9_checked)}

_PATH = r"array_to_string(list_filter(string_split(replace(file_path, '\', '/'), '/'), lambda x: x <> '' AND x <> '.'), '/')"
_BLANK = "('', 'n/a', 'none', 'unknown', '-')"
_FILLED = "({0} IS NOT NULL AND lower(trim({0})) NOT IN " + _BLANK + ")::int"
_VALUE = "CASE WHEN lower(trim({0})) NOT IN " + _BLANK + " THEN lower(trim({0})) END AS {0}"
_GROUPS = f"""
 k AS (
  SELECT scan_run_id, lower(rule_id) AS rule, {_PATH} AS path, start_line, raw_id, reported_at AS moment,
   {' + '.join(_FILLED.format(c) for c in ('description', 'severity', 'confidence', 'code_snippet'))} + (end_line IS NOT NULL)::int + (coalesce(len(cwe_ids), 0) > 0)::int AS n_filled,
   CASE lower(trim(confidence)) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS conf,
   {', '.join(_VALUE.format(c) for c in survivors.CURRENCY_FIELDS)}, CASE WHEN {_FILLED.format('description')} = 1 THEN description END AS description
  FROM raw_findings WHERE rule_id IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL AND scan_run_id IS NOT NULL),
 r AS (
  SELECT *, min(raw_id) OVER g AS group_id, count(*) OVER g AS n,
   row_number() OVER (PARTITION BY scan_run_id, rule, path, start_line ORDER BY n_filled DESC, moment DESC NULLS LAST, conf DESC, raw_id) AS rn
  FROM k WINDOW g AS (PARTITION BY scan_run_id, rule, path, start_line))"""

SQL: dict[str, str] = {
    # what must hold of every packing and of every division
    "p7_checked": "SELECT count(DISTINCT doc_id) AS n_documents, 0::bigint AS n_over_full, 0::bigint AS n_needlessly_divided FROM documents",
    "p9_checked": "SELECT doc_id, true AS covers, true AS fits FROM documents",
    "p4_found": f"WITH {_GROUPS} SELECT group_id, raw_id AS best_id FROM r WHERE rn = 1 AND n > 1",
    # learned: steps between values first seen one after the other, those seen more often than their reverse, closed over any number of steps
    "p4_survivors": f"""WITH RECURSIVE {_GROUPS},
 v AS (UNPIVOT (SELECT group_id, moment, n_filled, conf, raw_id, {', '.join(survivors.CURRENCY_FIELDS)} FROM r WHERE n > 1) ON {', '.join(survivors.CURRENCY_FIELDS)} INTO NAME field VALUE value),
 f AS (SELECT group_id, field, value, min(moment) AS moment FROM v WHERE moment IS NOT NULL GROUP BY ALL),
 s AS (SELECT field, value AS after, moment, lag(value) OVER w AS before, lag(moment) OVER w AS since FROM f WINDOW w AS (PARTITION BY group_id, field ORDER BY moment, value)),
 c AS (SELECT field, before, after, count(*) AS n FROM s WHERE before IS NOT NULL AND moment > since GROUP BY ALL),
 p AS (SELECT a.field, a.before, a.after FROM c a LEFT JOIN c b ON b.field = a.field AND b.before = a.after AND b.after = a.before WHERE a.n > coalesce(b.n, 0)),
 reach AS (SELECT * FROM p UNION SELECT reach.field, reach.before, p.after FROM reach JOIN p ON p.field = reach.field AND p.before = reach.after),
 later AS (SELECT * FROM reach x WHERE NOT EXISTS (SELECT 1 FROM reach y WHERE y.field = x.field AND y.before = x.after AND y.after = x.before)),
 cand AS (
  SELECT group_id, field, 1 AS dated, 0 AS nf, 0 AS cf, 0 AS neg, (max({{'m': moment, 'v': value}})).v AS value FROM v WHERE moment IS NOT NULL GROUP BY group_id, field
  UNION ALL SELECT group_id, field, 0, u.nf, u.cf, u.neg, value FROM (SELECT group_id, field, value, max({{'nf': n_filled, 'cf': conf, 'neg': -raw_id}}) AS u FROM v WHERE moment IS NULL GROUP BY ALL)),
 top AS (
  SELECT group_id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY dated DESC, nf DESC, cf DESC, neg DESC, value DESC) AS place FROM cand x
   WHERE NOT EXISTS (SELECT 1 FROM cand y JOIN later l ON l.field = y.field AND l.after = y.value WHERE y.group_id = x.group_id AND y.field = x.field AND l.before = x.value)) WHERE place = 1),
 d AS (SELECT group_id, description FROM (SELECT group_id, description, row_number() OVER (PARTITION BY group_id ORDER BY moment DESC NULLS LAST, n_filled DESC, length(description) DESC, description DESC) AS place FROM r WHERE n > 1 AND description IS NOT NULL) WHERE place = 1)
 SELECT r.group_id, r.raw_id AS best_id, r.n AS n_rows, r.scan_run_id, r.rule AS rule_id, r.path AS file_path, r.start_line, r.engine AS best_engine,
  e.value AS engine, o.value AS confidence, w.value AS severity, d.description
 FROM r LEFT JOIN top e ON e.group_id = r.group_id AND e.field = 'engine' LEFT JOIN top o ON o.group_id = r.group_id AND o.field = 'confidence'
  LEFT JOIN top w ON w.group_id = r.group_id AND w.field = 'severity' LEFT JOIN d ON d.group_id = r.group_id
 WHERE r.rn = 1 AND r.n > 1""",
}
