"""Readers and writers: source trees, event logs, tool reports, ground truth, SARIF.

Readers are tolerant where the scanners are: lines that do not parse are left out (and can be had with ``corrupt``), never an
error. Schemas are given, not inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.functions.text import parse_instant
from oreline.operators.finding_text import message

#: Folders that are not scanned, endings that are, and their languages.
SKIPPED = ("node_modules", ".git", "dist", "build", "vendor")
LANGUAGES = {"js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "c": "c", "h": "c", "go": "go", "php": "php", "rb": "ruby"}
USAGE = "ts string, capability string, provider string, model string, prompt_tokens bigint, completion_tokens bigint, cost_usd double, scan_id string, meta string, _corrupt string"
SEMGREP = "results array<struct<check_id string, path string, start struct<line int>, extra struct<message string, severity string, metadata struct<cwe array<string>>>>>"
TRIVY = "Results array<struct<Target string, Vulnerabilities array<struct<VulnerabilityID string, PkgName string, InstalledVersion string, FixedVersion string, Severity string, Title string>>>>"


def language_of(path: Column | str, default: str = "python") -> Column:
    """Language of a path by its ending."""
    path = F.col(path) if isinstance(path, str) else path
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.element_at(table, F.nullif(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit(""))), F.lit(default))


def read_tree(spark: SparkSession, root: str, max_bytes: int = 10_000_000) -> DataFrame:
    """(path, language, n_bytes, text) of the source files under a folder, one row a file; skipped folders are pruned by path. Files above ``max_bytes`` keep their
    row with a null text, so that they can be counted (``too_large``) or read with a higher limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    keep = ending.isin(*LANGUAGES) & ~F.col("path").rlike("/(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/")
    text = F.when(F.col("length") <= max_bytes, F.col("content").cast("string"))
    return files.where(keep).select("path", language_of("path").alias("language"), F.col("length").alias("n_bytes"), text.alias("text"))


def too_large(tree: DataFrame) -> DataFrame:
    """(language, n_files, n_bytes) of the files whose text was not read."""
    return tree.where("text is null").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def read_usage(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Usage events of a JSON-lines log; blank and corrupt lines and rows without a real time are left out; bounds are inclusive."""
    rows = spark.read.schema(USAGE).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where("_corrupt is null").drop("_corrupt").withColumn("at", parse_instant("ts")).where("at is not null")
    if since:
        rows = rows.where(F.col("at") >= F.lit(since).cast("timestamp"))
    return rows.where(F.col("at") <= F.lit(until).cast("timestamp")) if until else rows


def semgrep_findings(reports: DataFrame, column: str = "report") -> DataFrame:
    """Findings of JSON reports of a rule scanner, one row a result; results without a path are left out."""
    r = reports.select(F.explode(F.from_json(column, SEMGREP)["results"]).alias("r")).where("r.path is not null")
    return r.select(F.col("r.check_id").alias("rule_id"), F.col("r.path").alias("file_path"), F.coalesce("r.start.line", F.lit(1)).alias("line"), F.coalesce("r.extra.severity", F.lit("WARNING")).alias("severity"), F.get("r.extra.metadata.cwe", F.lit(0)).alias("cwe"), F.col("r.extra.message").alias("message"), F.lit(0.8).alias("confidence"))


def trivy_findings(reports: DataFrame, column: str = "report") -> DataFrame:
    """Findings of JSON reports of a dependency scanner, one row a vulnerability."""
    t = reports.select(F.explode(F.from_json(column, TRIVY)["Results"]).alias("t")).select("t.Target", F.explode("t.Vulnerabilities").alias("v"))
    return t.select(F.col("v.VulnerabilityID").alias("rule_id"), F.col("Target").alias("file_path"), F.lit(1).alias("line"), F.col("v.Severity").alias("severity"), F.col("v.Title").alias("message"), F.lit(0.9).alias("confidence"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of a CSV file (name, category, isReal, ...): comments are skipped, real cases kept."""
    rows = spark.read.option("comment", "#").schema("name string, category string, is_real string, cwe string").csv(path)
    return rows.where("category is not null and lower(trim(is_real)) = 'true'").select("name", "category", "cwe")


def sarif(findings: DataFrame) -> DataFrame:
    """One SARIF 2.1.0 document (column ``document``) of (rule_id, title, severity, message, file_path, line): a rule for each rule_id (its first
    title), results in the order of path, line and rule. The document itself is one value: for the findings of one scan."""
    level = F.when(F.lower("severity").isin("critical", "high"), "error").when(F.lower("severity") == "medium", "warning").otherwise("note")
    text = message(F.coalesce("message", F.lit("")))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"))
    rows = findings.select(F.struct("file_path", "line", "rule_id", result.alias("result")).alias("o"), F.struct(F.col("rule_id").alias("id"), F.col("title").alias("name")).alias("rule"))
    rules = F.transform(F.array_distinct(F.transform(F.sort_array(F.collect_list("rule")), lambda r: r["id"])), lambda i: F.struct(i.alias("id")))
    one = rows.agg(F.transform(F.sort_array(F.collect_list("o")), lambda o: o["result"]).alias("results"), rules.alias("rules"))
    doc = F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(F.struct(F.struct(F.lit("oreline").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))).alias("runs"))
    return one.select(F.to_json(doc).alias("document"))


def read_truth_json(spark: SparkSession, path: str) -> DataFrame:
    """(category, file, type, line, is_real) of ground truth given as ``{category: {positives: [...], negatives: [...]}}``."""
    entry = "array<struct<file:string,type:string,line:int>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<positives:{entry},negatives:{entry}>>").alias("m")).select(F.explode("m").alias("category", "v"))
    each = lambda c, real: rows.select("category", F.explode(f"v.{c}").alias("e"), F.lit(real).alias("is_real"))
    return each("positives", True).unionByName(each("negatives", False)).select("category", "e.file", "e.type", "e.line", "is_real")


def read_state(spark: SparkSession, path: str, statuses: tuple[str, ...] = ("open", "confirmed", "fixed", "false_positive", "accepted_risk")) -> DataFrame:
    """(fp, status, by, at) of a triage state ``{version, fingerprints: {fp: {status, by, at}}}``; entries without a known status are left out, a missing author
    is 'unknown'. A file that is no JSON has no entries."""
    kind = "struct<version:int,fingerprints:map<string,struct<status:string,by:string,at:string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("s")).select(F.explode("s.fingerprints").alias("fp", "e"))
    return rows.select("fp", "e.status", F.coalesce("e.by", F.lit("unknown")).alias("by"), F.coalesce("e.at", F.lit("")).alias("at")).where(F.col("status").isin(*statuses))


def engine_status(reports: DataFrame) -> DataFrame:
    """(engine, status, n_findings) of raw engine outputs (engine, report, exit_code, timed_out): success, partial (findings although the engine failed), failed, timeout."""
    n = F.coalesce(F.size(F.from_json("report", "struct<findings:array<struct<rule_id:string>>>")["findings"]), F.lit(0))
    n = F.greatest(n, F.lit(0))
    status = F.when(F.coalesce("timed_out", F.lit(False)), "timeout").when(F.coalesce("exit_code", F.lit(0)) == 0, "success").when(n > 0, "partial").otherwise("failed")
    return reports.select("engine", status.alias("status"), n.alias("n_findings"))


def append_usage(events: DataFrame, path: str) -> None:
    """Append usage events to a JSON-lines log; readers see whole files only."""
    events.write.mode("append").json(path)


def export_audit(rows: DataFrame, path: str) -> DataFrame:
    """Write rows as CSV (quoted as RFC 4180 asks) and give (file, digest): the SHA-256 of each part, the export's manifest."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    parts = rows.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return parts.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))


def export_json(rows: DataFrame, exported_at: str) -> DataFrame:
    """One JSON document ``{exported_at, total, events}`` of a bounded selection of log rows."""
    return rows.agg(F.to_json(F.struct(F.lit(exported_at).alias("exported_at"), F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_list(F.struct(*rows.columns))).alias("events"))).alias("document"))
