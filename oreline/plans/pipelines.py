"""The scan pipeline over the findings' snippets, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline import pipeline
from oreline.operators import rules
from oreline.plans import code as code_plans
from oreline.plans.texts import q
from oreline.session import table


def _found(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.analyse(table(spark, d, "raw_findings").select(F.col("raw_id").alias("path"), F.col("code_snippet").alias("text"))).withColumnRenamed("file_path", "raw_id")


def pipe_f7_analyse(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("raw_id", "line", "rule_id", "severity", "confidence")


def comb_e4_pipeline(spark: SparkSession, d: str) -> DataFrame:
    kept = pipeline.detections([_found(spark, d)], "high", 0.8)
    return kept.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


QUERIES = {f.__name__: f for f in (pipe_f7_analyse, comb_e4_pipeline)}

_FOUND = f"""{code_plans._SNIP},
 lc AS (SELECT * FROM l WHERE NOT (contains(line, '//') OR starts_with(ltrim(line), '#') OR starts_with(ltrim(line), '*') OR starts_with(ltrim(line), '/*'))),
 h AS (SELECT raw_id, line_no AS line, rule_id, severity, confidence::double AS confidence FROM lc JOIN (VALUES {code_plans._RULES}) r(rule_id, severity, confidence, p) ON regexp_matches(lc.line, p, 'i')),
 w AS (SELECT DISTINCT raw_id, line_no AS line, upper(type) AS rule_id, 'medium' AS severity, 0.7::double AS confidence FROM lc JOIN (VALUES {', '.join(f'({q(t)}, {q(p)})' for t, p in rules.WEAK_RULES)}) r(type, p) ON regexp_matches(lc.line, p)),
 found AS (SELECT * FROM h UNION ALL SELECT * FROM w ANTI JOIN h ON h.raw_id = w.raw_id AND h.line = w.line)"""

SQL = {
    "pipe_f7_analyse": f"WITH {_FOUND} SELECT * FROM found",
    "comb_e4_pipeline": f"WITH {_FOUND} SELECT severity, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM found WHERE severity IN ('critical', 'high') AND confidence >= 0.8 GROUP BY 1",
}
