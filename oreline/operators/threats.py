"""Taint paths within a scope, and the threat model built on them: boundaries, threats, schedules, risk and coverage.

Paths start from the hits of one file (``operators.code.taint_marks``), which are gathered per file as short arrays; everything after them is
equi-joins and grouped maxima on (scope, source type, sink type), so that a file with many paths is reduced before anything is moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Callee names by their role.
CALL_SOURCES = {
    "input": "user_input", "read": "user_input", "readline": "user_input", "gets": "user_input", "raw_input": "user_input", "readFile": "file_io", "readFileSync": "file_io",
    "fopen": "file_io", "fread": "file_io", "open": "file_io", "file_get_contents": "file_io", "fetch": "network", "urlopen": "network", "getenv": "env",
}
CALL_SINKS = {
    "eval": "eval", "exec": "shell", "system": "shell", "popen": "shell", "shell_exec": "shell", "subprocess_call": "shell", "subprocess_run": "shell", "query": "sql", "execute": "sql",
    "raw": "sql", "writeFile": "file_write", "writeFileSync": "file_write", "fwrite": "file_write", "unserialize": "deserialization", "pickle_loads": "deserialization",
}
CALL_SANITIZERS = {
    "htmlspecialchars": "encoding", "htmlentities": "encoding", "urlencode": "encoding", "encodeURI": "encoding", "encodeURIComponent": "encoding", "escape": "encoding",
    "DOMPurify_sanitize": "sanitization", "addslashes": "escaping", "mysqli_real_escape_string": "escaping", "pg_escape_string": "escaping", "intval": "type_cast",
    "parseInt": "type_cast", "parseFloat": "type_cast", "Number": "type_cast", "validate": "validation", "isValid": "validation", "sanitize": "validation",
}
CALLS = tuple((name, role, kind) for role, names in (("source", CALL_SOURCES), ("sink", CALL_SINKS), ("sanitizer", CALL_SANITIZERS)) for name, kind in names.items())

#: Threat categories of a source's and a sink's type, with weaknesses, list entry and rule prefixes.
STRIDE = (
    ("tampering", "user_input", "sql", ("CWE-89",), "A03:2021", ("INJ",)),
    ("tampering", "user_input", "shell", ("CWE-78",), "A03:2021", ("INJ",)),
    ("tampering", "user_input", "eval", ("CWE-94",), "A03:2021", ("INJ",)),
    ("tampering", "user_input", "file_write", ("CWE-22", "CWE-49"), "A03:2021", ("INJ",)),
    ("tampering", "user_input", "dynamic_code", ("CWE-94",), "A03:2021", ("INJ",)),
    ("tampering", "network", "sql", ("CWE-89",), "A03:2021", ("INJ",)),
    ("tampering", "network", "shell", ("CWE-78",), "A03:2021", ("INJ",)),
    ("tampering", "network", "eval", ("CWE-94",), "A03:2021", ("INJ",)),
    ("spoofing", "cookie", "sql", ("CWE-287", "CWE-384"), "A07:2021", ("AUTH",)),
    ("spoofing", "header", "sql", ("CWE-287", "CWE-613"), "A07:2021", ("AUTH",)),
    ("spoofing", "network", "eval", ("CWE-94", "CWE-287"), "A07:2021", ("INJ", "AUTH")),
    ("repudiation", "cookie", "sql", ("CWE-778",), "A09:2021", ("AUTH",)),
    ("repudiation", "header", "sql", ("CWE-778", "CWE-295"), "A09:2021", ("AUTH",)),
    ("information_disclosure", "user_input", "network_send", ("CWE-201", "CWE-352"), "A01:2021", ("INJ",)),
    ("information_disclosure", "db", "network_send", ("CWE-200", "CWE-532"), "A01:2021", ("CRYPTO",)),
    ("information_disclosure", "file_io", "network_send", ("CWE-200", "CWE-532"), "A01:2021", ("CRYPTO",)),
    ("information_disclosure", "env", "network_send", ("CWE-200", "CWE-532"), "A01:2021", ("CRYPTO",)),
    ("information_disclosure", "cookie", "network_send", ("CWE-532",), "A01:2021", ("CRYPTO",)),
    ("denial_of_service", "user_input", "eval", ("CWE-400", "CWE-770"), "A05:2021", ("INJ",)),
    ("denial_of_service", "user_input", "file_write", ("CWE-400", "CWE-789"), "A05:2021", ("INJ", "MEM")),
    ("denial_of_service", "network", "eval", ("CWE-400",), "A05:2021", ("INJ",)),
    ("elevation_of_privilege", "user_input", "shell", ("CWE-78", "CWE-269"), "A01:2021", ("INJ", "AUTH")),
    ("elevation_of_privilege", "env", "shell", ("CWE-78", "CWE-862"), "A01:2021", ("INJ", "AUTH")),
    ("elevation_of_privilege", "network", "shell", ("CWE-78",), "A01:2021", ("INJ", "AUTH")),
    ("elevation_of_privilege", "user_input", "eval", ("CWE-94", "CWE-269"), "A01:2021", ("INJ", "AUTH")),
    ("elevation_of_privilege", "user_input", "deserialization", ("CWE-502",), "A08:2021", ("INJ",)),
)
WEIGHTS = {"tampering": 90, "elevation_of_privilege": 85, "spoofing": 75, "information_disclosure": 70, "denial_of_service": 55, "repudiation": 45}
CATEGORIES = ("spoofing", "tampering", "repudiation", "information_disclosure", "denial_of_service", "elevation_of_privilege")
SANITIZER_PENALTY, BOUNDARY_LEAST, SCHEDULE_LEAST, CRITICAL = 30, 0.4, 20, 70


def calls(src: DataFrame, key: str) -> DataFrame:
    """(key, line_no, callee, role, type): the calls of each line whose callee's last part is a known source, sink or sanitizer."""
    names = F.regexp_extract_all("line", F.lit(r"([A-Za-z_$][\w$.]*)\s*\("), F.lit(1))
    each = src.select(key, "line_no", F.explode(names).alias("name")).select(key, "line_no", F.substring_index("name", ".", -1).alias("callee"))
    known = src.sparkSession.createDataFrame(list(CALLS), "callee string, role string, type string")
    return each.join(F.broadcast(known), "callee").select(key, "line_no", "callee", "role", "type")  # some forty names


def _pairs(marks: DataFrame, key: str, path) -> DataFrame:
    """The structs ``path`` makes of each source and sink of a file (null for none), in the order of lines and rules."""
    m = marks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_no", "var", "sources", "sinks", "cleans"))).alias("m"))
    each = lambda f: F.flatten(F.transform("m", lambda x: F.transform(x[f], lambda y: F.struct(x["line_no"].alias("line"), y["o"].alias("o"), y["type"].alias("type"), y["c"].alias("c")))))
    m = m.select(key, each("sources").alias("so"), each("sinks").alias("si"), each("cleans").alias("sa")).where("size(so) > 0 and size(si) > 0")
    made = F.flatten(F.transform("so", lambda s: F.filter(F.transform("si", lambda k: path(s, k)), lambda p: p.isNotNull())))
    return m.select(key, F.posexplode(made).alias("ordinal", "p")).select(key, "ordinal", "p.*")


def _between(s: Column, k: Column) -> Column:
    return F.filter("sa", lambda x: (x["line"] > s["line"]) & (x["line"] < k["line"]))


def scoped_paths(marks: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, source_line, sink_line, source_type, sink_type, sanitized, confidence): sinks on or after a source in the same scope; .85, or .4 with a
    sanitizer in between."""

    def path(s: Column, k: Column) -> Column:
        clean = F.size(_between(s, k)) > 0
        out = F.struct(s["line"].alias("source_line"), k["line"].alias("sink_line"), s["type"].alias("source_type"), k["type"].alias("sink_type"), clean.alias("sanitized"), F.when(clean, 0.4).otherwise(0.85).alias("confidence"))
        return F.when(k["line"] >= s["line"], out)

    return _pairs(marks, key, path)


def enhanced_paths(marks: DataFrame, key: str, least: float = 0.3) -> DataFrame:
    """(key, ordinal, source_line, sink_line, source_type, sink_type, confidence): all sources and sinks of a scope, in either order of lines; the product of
    both confidences and of what each sanitizer in between leaves, where that is above ``least``."""

    def path(s: Column, k: Column) -> Column:
        conf = F.aggregate(_between(s, k), s["c"] * k["c"], lambda a, x: a * (1 - x["c"]))
        out = F.struct(s["line"].alias("source_line"), k["line"].alias("sink_line"), s["type"].alias("source_type"), k["type"].alias("sink_type"), conf.alias("confidence"))
        return F.when(conf > least, out)

    return _pairs(marks, key, path)


def enhanced_result(paths: DataFrame, key: str) -> DataFrame:
    """Per scope the number of paths, their mean confidence, and the flag for flows between procedures, which needs paths of more than five nodes
    and is false, as every path has two."""
    return paths.groupBy(key).agg(F.count(F.lit(1)).alias("n_paths"), F.avg("confidence").alias("confidence")).withColumn("inter_procedural", F.lit(False))


def boundary_type(source: Column, sink: Column) -> Column:
    out = F.when(source.isin("network", "header", "cookie"), "network").when(source.isin("db", "file_io"), "data_store").when(sink.isin("sql", "db"), "data_store")
    return out.when(sink == "network_send", "output").when(sink.isin("shell", "eval", "dynamic_code"), "process").otherwise("input")


def trust_boundaries(paths: DataFrame, key: str) -> DataFrame:
    """(key, source_type, sink_type, type, line, confidence): the first path of each scope and pair of types with a confidence of at least .4. A scope's
    boundaries of one name are one: the most confident."""
    first = paths.where(F.col("confidence") >= BOUNDARY_LEAST).groupBy(key, "source_type", "sink_type").agg(F.min(F.struct("ordinal", "source_line", "confidence")).alias("f"))
    return first.select(key, "source_type", "sink_type", boundary_type(F.col("source_type"), F.col("sink_type")).alias("type"), F.col("f.source_line").alias("line"), F.col("f.confidence").alias("confidence"))


def stride_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, s, t, list(w), o, list(r)) for k, (c, s, t, w, o, r) in enumerate(STRIDE)], "n int, category string, source_type string, sink_type string, cwes array<string>, owasp string, rules array<string>")


def priority(category: Column, confidence: Column, sanitized: Column) -> Column:
    """Rounded half up, between 0 and 100."""
    base = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in WEIGHTS.items() for x in pair)), category), F.lit(50)) - F.when(sanitized, SANITIZER_PENALTY).otherwise(0)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base * confidence)) + 0.5).cast("int")


def threats(paths: DataFrame, key: str) -> DataFrame:
    """(key, category, source_type, sink_type, cwes, owasp, rules, priority): per scope and category the first path of each pair of types."""
    first = paths.groupBy(key, "source_type", "sink_type").agg(F.min(F.struct("ordinal", "confidence", "sanitized")).alias("f"))
    mapped = first.join(F.broadcast(stride_rows(paths.sparkSession)), ["source_type", "sink_type"])  # 26 rows
    return mapped.select(key, "category", "source_type", "sink_type", "cwes", "owasp", "rules", priority(F.col("category"), F.col("f.confidence"), F.col("f.sanitized")).alias("priority"))


def schedule(found: DataFrame, key: str) -> DataFrame:
    """(key, category, rules, priority): of the threats of a priority of at least 20 the most urgent of each category and set of rules."""
    rules = F.array_join(F.array_sort("rules"), ",")
    return found.where(F.col("priority") >= SCHEDULE_LEAST).groupBy(key, "category", rules.alias("rules")).agg(F.max("priority").alias("priority"))


def risk_assessment(found: DataFrame, key: str) -> DataFrame:
    """Per scope: overall risk (of six categories at 90 each), critical threats, and the capped sum of each category."""
    total = F.sum("priority")
    per = [F.least(F.lit(100), F.coalesce(F.sum(F.when(F.col("category") == c, F.col("priority"))), F.lit(0))).cast("int").alias(c) for c in CATEGORIES]
    overall = F.least(F.lit(100), F.floor(total / (len(CATEGORIES) * 90) * 100 + 0.5)).cast("int")
    return found.groupBy(key).agg(overall.alias("overall"), F.count_if(F.col("priority") >= CRITICAL).alias("critical_paths"), *per)


def coverage(found: DataFrame, reports: DataFrame, key: str) -> DataFrame:
    """Per scope: threats, how many of them a report of the scope (key, cwes) speaks of, the rounded share in percent, and the categories without any."""
    weakness = found.select(key, "category", "source_type", "sink_type", F.explode("cwes").alias("cwe"))
    held = weakness.join(reports.select(key, F.explode("cwes").alias("cwe")).distinct(), [key, "cwe"], "left_semi").select(key, "category", "source_type", "sink_type").distinct().withColumn("scanned", F.lit(1))
    per = found.join(held, [key, "category", "source_type", "sink_type"], "left").groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.count("scanned").alias("scanned"), F.collect_set(F.when(F.col("scanned") == 1, F.col("category"))).alias("covered"),
    )
    missing = F.array_join(F.array_except(F.array(*map(F.lit, CATEGORIES)), "covered"), ",")
    return per.select(key, "total", "scanned", F.floor(F.col("scanned") / F.col("total") * 100 + 0.5).cast("int").alias("percent"), missing.alias("unscanned"))


#: What in the text around a sink makes a path safer: (test, sink types, factor), the first that holds counts.
def safety_factor(sink: Column, line: Column, near: Column, wide: Column) -> Column:
    """Factor of a path's confidence from its sink's line and the text around it."""
    numeric = wide.rlike(r"is_numeric\s*\([^)]*\)") & sink.isin("shell", "file_include")
    out = F.when(sink.isin("securecookie", "secure_cookie") & near.rlike(r"setSecure\s*\(\s*true\s*\)") & near.rlike(r"setHttpOnly\s*\(\s*true\s*\)"), 0.1)
    out = out.when(sink.isin("crypto", "hash", "weakrand"), 1.0)
    out = out.when(sink.isin("trustbound", "trust_bound") & near.rlike(r"encodeForHTML|ESAPI\.encoder|htmlEscape|HTMLEncoder"), 0.3)
    out = out.when(line.rlike(r"allow-listed|whitelist|isAllowed|validated"), 0.4)
    out = out.when(numeric & (F.regexp_count(wide, F.lit(r"is_numeric\s*\(")) >= 3), 0.15).when(numeric, 0.4)
    out = out.when(wide.rlike(r"intval\s*\([^)]*\)|filter_var\s*\([^,]+,\s*FILTER_VALIDATE_(INT|EMAIL|URL|FLOAT|BOOLEAN)") & sink.isin("shell", "file_include", "sql", "ssrf"), 0.3)
    out = out.when(wide.rlike(r"""preg_match\s*\(\s*['"]/[^'"]*['"]\s*,\s*\$\w+""") & sink.isin("shell", "file_include", "ssrf", "eval"), 0.25)
    out = out.when(wide.rlike(r"""(?i)mysql_real_escape_string|mysqli_real_escape_string|pg_escape_string|PreparedStatement|\$\w+\s*=\s*['"][^'"]*['"]\s*\.\s*\$""") & (sink == "sql"), 0.3)
    return out.when(wide.rlike(r"(?i)htmlspecialchars\s*\(|htmlentities\s*\(|strip_tags\s*\(") & (sink == "xss"), 0.15).otherwise(1.0)


def safe_findings(paths: DataFrame, src: DataFrame, key: str, least: float = 0.2) -> DataFrame:
    """(key, sink_type, sink_line, confidence): the first path of each sink type and line, weakened by the text around the sink (lines n-9 to n+2, and
    n-29 to n+5), where at least ``least`` is left. The first of equal sinks is taken before the weak are dropped."""
    from pyspark.sql.window import Window

    first = paths.groupBy(key, "sink_type", "sink_line").agg(F.min(F.struct("ordinal", "confidence")).alias("f"))
    w = Window.partitionBy(key).orderBy("line_no")
    text = lambda a, b: F.array_join(F.collect_list("line").over(w.rowsBetween(a, b)), "\n")
    around = src.join(first.select(key).distinct(), key, "left_semi").select(key, F.col("line_no").alias("sink_line"), "line", text(-9, 2).alias("near"), text(-29, 5).alias("wide"))
    conf = F.col("f.confidence") * safety_factor(F.col("sink_type"), F.col("line"), F.col("near"), F.col("wide"))
    return first.join(around, [key, "sink_line"]).select(key, "sink_type", "sink_line", conf.alias("confidence")).where(F.col("confidence") >= least)
