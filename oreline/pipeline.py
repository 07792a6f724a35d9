"""Scans from end to end: source tree or text to findings, states and reports, each one plan from reader to sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import code, finding_text, relational, reports, rules, threats
from oreline.sources import files

#: Weak patterns carry no score of their own (fixed values).
WEAK_SEVERITY, WEAK_CONFIDENCE = "medium", 0.7


def is_comment(line: Column) -> Column:
    """Lines that only comment, or hold ``//`` anywhere (so that addresses count)."""
    bare = F.ltrim(line)
    return F.contains(line, F.lit("//")) | bare.startswith("#") | bare.startswith("*") | bare.startswith("/*")


def analyse(texts: DataFrame, skip_comments: bool = True) -> DataFrame:
    """(file_path, line, rule_id, severity, confidence, title, message) of (path, text): line rules, and weak patterns where no rule hit that line. Null texts have
    no findings."""
    lines = code.lines(texts.select(F.col("path").alias("file_path"), "text"), "file_path", "text")
    if skip_comments:
        lines = lines.where(~is_comment(F.col("line")))
    hits = code.rule_hits(lines, "file_path").select("file_path", F.col("line_no").alias("line"), "rule_id", "severity", F.col("confidence").cast("double"))
    weak = code.typed_hits(lines, "file_path", rules.WEAK_RULES).select("file_path", F.col("line_no").alias("line"), F.upper("type").alias("rule_id"), F.lit(WEAK_SEVERITY).alias("severity"), F.lit(WEAK_CONFIDENCE).alias("confidence"))
    weak = weak.join(hits.select("file_path", "line").distinct(), ["file_path", "line"], "left_anti").select(*hits.columns)
    return hits.unionByName(weak).withColumn("title", F.col("rule_id")).withColumn("message", F.concat(F.col("rule_id"), F.lit(" in line "), F.col("line")))


def detections(frames: Sequence[DataFrame], least_severity: str = "low", least_confidence: float = 0.3) -> DataFrame:
    """The detections of several detectors end to end (nothing is merged), those of at least the severity and the confidence."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.where((relational.severity_rank("severity") >= relational.severity_rank(F.lit(least_severity))) & (F.col("confidence") >= least_confidence))


def fingerprint() -> Column:
    return F.concat_ws(":", "file_path", F.col("line").cast("string"), "rule_id")


def scan(spark: SparkSession, root: str, least_severity: str = "low", least_confidence: float = 0.3, baseline: DataFrame | None = None, state: DataFrame | None = None, show: Sequence[str] = ("open", "confirmed")) -> DataFrame:
    """Findings of a source tree: read, analysed, filtered, without those of the baseline (fp), with the triage status (fp, status; 'open' where there is none)
    and only those whose status is shown."""
    found = detections([analyse(files.read_tree(spark, root))], least_severity, least_confidence).withColumn("fp", fingerprint()).dropDuplicates(["fp"])
    if baseline is not None:
        found = found.join(baseline.select("fp").distinct(), "fp", "left_anti")
    held = found.withColumn("status", F.lit("open")) if state is None else found.join(state.select("fp", "status"), "fp", "left").withColumn("status", F.coalesce("status", F.lit("open")))
    return held.where(F.col("status").isin(*show))


def scan_project(spark: SparkSession, roots: Sequence[str], **options) -> DataFrame:
    """Findings of several trees with the column ``project``, in one plan."""
    out = None
    for root in roots:
        df = scan(spark, root, **options).withColumn("project", F.lit(root))
        out = df if out is None else out.unionByName(df)
    return out


def scan_code(spark: SparkSession, text: str, name: str = "snippet") -> DataFrame:
    """Findings of one text."""
    return analyse(spark.createDataFrame([(name, text)], "path string, text string"))


def list_rules(spark: SparkSession, category: str | None = None, severity: str | None = None) -> DataFrame:
    """The line rules (rule_id, severity, confidence, pattern), of a category or a severity where given."""
    rows = spark.createDataFrame([(i, s, float(c), p) for i, s, c, p in rules.LINE_RULES], "rule_id string, severity string, confidence double, pattern string")
    if category:
        rows = rows.where(reports.rule_category(F.col("rule_id")) == category)
    return relational.where_all(rows, {"severity": severity})


def lookup_cwe(spark: SparkSession, cwe: str) -> DataFrame:
    """(type, severity) of the sink types that stand for a weakness."""
    rows = spark.createDataFrame(list(finding_text.SINK_CWE.items()), "type string, cwe string").where(F.col("cwe") == cwe)
    return rows.select("type", finding_text.lookup(finding_text.SINK_SEVERITY, F.col("type"), F.lit("MEDIUM")).alias("severity"))


def threat_model(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Boundaries, threats and the risk of each text of (path, text)."""
    lines = code.lines(texts.select("path", "text"), "path", "text")
    paths = threats.scoped_paths(code.taint_marks(lines, "path"), "path")
    found = threats.threats(paths, "path")
    return threats.trust_boundaries(paths, "path"), found, threats.risk_assessment(found, "path")


def attack_surface(texts: DataFrame) -> DataFrame:
    """(path, n_sinks, n_boundaries, risk): reachable sinks, boundaries and the capped risk of each text."""
    boundaries, found, _ = threat_model(texts)
    sinks = found.groupBy("path").agg(F.countDistinct("sink_type").alias("n_sinks"))
    n = boundaries.groupBy("path").agg(F.count(F.lit(1)).alias("n_boundaries"))
    both = n.join(sinks, "path", "left").withColumn("n_sinks", F.coalesce("n_sinks", F.lit(0)))
    risk = F.least(F.lit(100), F.least(F.lit(30), F.col("n_sinks") * 10) + F.least(F.lit(30), F.col("n_boundaries") * 15) + F.least(F.lit(40), F.col("n_boundaries") * 20))
    return both.withColumn("risk", risk)


def json_report(findings: DataFrame) -> DataFrame:
    """One JSON document of the findings of one scan: counts by severity, then the findings by path, line and rule."""
    cols = ["file_path", "line", "rule_id", "severity", "confidence", "message"]
    counts = F.struct(*(F.count_if(relational.severity_rank("severity") == k).alias(n) for n, k in (("critical", 4), ("high", 3), ("medium", 2), ("low", 1))))
    return findings.agg(F.to_json(F.struct(counts.alias("summary"), F.sort_array(F.collect_list(F.struct(*cols))).alias("findings"))).alias("document"))
