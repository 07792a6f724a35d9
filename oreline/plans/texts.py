"""Messages, validation, families and features of findings and code, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import finding_text as T
from oreline.operators import locator
from oreline.operators.relational import severity_rank
from oreline.session import table

#: How the test tables name what the rules speak of: the second part of a rule_id is the finding's type; a weakness names the type of a report.
CWE_TYPES = {
    "CWE-89": "SQL Injection", "CWE-78": "Command Injection", "CWE-79": "Cross-Site Scripting (XSS)", "CWE-22": "Path Traversal", "CWE-918": "Server-Side Request Forgery",
    "CWE-327": "Insecure Cryptography", "CWE-798": "Hardcoded Secret", "CWE-862": "Authentication Bypass", "CWE-502": "Insecure Deserialization", "CWE-611": "XML External Entity", "CWE-601": "Open Redirect",
}
STRIDE_NAMES = {"S": "Spoofing", "T": "Tampering", "R": "Repudiation", "I": "Information Disclosure", "D": "Denial of Service", "E": "Elevation of Privilege"}


def kind_of(rule: str = "rule_id") -> Column:
    return F.lower(F.split_part(F.col(rule), F.lit("-"), F.lit(2)))


def txt_t08_validation(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings")
    conf = F.lower(F.trim("confidence"))
    number = F.when(conf == "high", 0.96).when(conf == "medium", 0.6).when(conf == "low", 0.3)
    kind = T.lookup(CWE_TYPES, F.get("cwe_ids", F.lit(0)), F.lit(""))
    reason, risk = T.validation(kind, F.col("severity"), F.col("end_line") - F.col("start_line") + 1, F.col("description"), F.lit(None).cast("string"), F.col("code_snippet"), number)
    return raw.select("raw_id", reason.alias("reason"), risk.cast("int").alias("risk"))


def txt_t10_message(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "raw_findings").select(F.concat(F.lit("f"), F.col("raw_id")).alias("id"), T.message(F.col("description")).alias("message"))
    return found.unionByName(table(spark, d, "poc_runs").select(F.concat(F.lit("p"), F.col("id")).alias("id"), T.message(F.col("stdout_log")).alias("message"))).distinct()


def txt_t13_families(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_findings").groupBy(T.family(kind_of()).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def txt_t14_weakness(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings").select("raw_id", kind_of().alias("kind"))
    return raw.select("raw_id", T.lookup(T.SINK_SEVERITY, F.col("kind"), F.lit("MEDIUM")).alias("severity"), T.lookup(T.SINK_CWE, F.col("kind"), F.lit("CWE-707")).alias("cwe"))


def agg_a20_stride(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "raw_findings").select(F.explode(F.split(T.lookup(T.TYPE_STRIDE, kind_of(), F.lit("T")), "")).alias("c"))
    names = spark.createDataFrame(list(STRIDE_NAMES.items()), "c string, category string")
    return F.broadcast(names).join(raw.groupBy("c").agg(F.count(F.lit(1)).alias("k")), "c", "left").select("category", F.coalesce("k", F.lit(0)).alias("n"))  # six rows


def risk_r5_shares(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "raw_findings").groupBy("project_id", T.family(kind_of()).alias("family")).agg(F.sum(severity_rank("severity")).alias("w"))
    top = per.groupBy("project_id").agg(F.sum("w").alias("total"), F.max(F.struct("w", "family")).alias("m"))
    return top.select("project_id", F.col("m.family").alias("dominant"), F.when(F.col("total") > 0, F.round(F.col("m.w") / F.col("total"), 6)).otherwise(0.0).alias("share"))


def txt_t20_probe(spark: SparkSession, d: str) -> DataFrame:
    std = T.deviation(T.probe_features(F.col("code")))
    found = table(spark, d, "training_samples").where("code is not null").select("id", std.alias("std"))
    return found.where("std > 2.5").select("id", F.round("std", 6).alias("std"), F.round(F.least(F.col("std") / 5, F.lit(1.0)), 6).alias("confidence"))


def txt_t21_features(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "training_samples").where("code is not null").select("id", *(F.round(c, 6).alias(n) for n, c in T.code_features(F.col("code")).items()))


QUERIES = {f.__name__: f for f in (txt_t08_validation, txt_t10_message, txt_t13_families, txt_t14_weakness, agg_a20_stride, risk_r5_shares, txt_t20_probe, txt_t21_features)}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def case(table: dict[str, str], c: str, other: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


KIND = "lower(split_part(rule_id, '-', 2))"
_PLAIN = f"regexp_replace(coalesce({KIND}, ''), '[^a-z0-9_]', '', 'g')"
FAMILY = case(T.TYPE_FAMILIES, _PLAIN, _PLAIN)
_RANK = "CASE lower(severity) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"


def _clean(c: str) -> str:
    for p in T.CODE_LIKE:
        c = f"regexp_replace({c}, {q(p)}, '[code-stripped]', 'g')"
    return c


_N = "len(regexp_extract_all(code, {0}))"
_RISK = "CASE WHEN conf > 0.95 AND sev = 'critical' THEN 1 ELSE 0 END + CASE WHEN length(txt) BETWEEN 1 AND 9 THEN 2 ELSE 0 END" + "".join(f" + CASE WHEN regexp_matches(txt, {q(p)}) THEN 5 ELSE 0 END" for p in T.SUSPICIOUS)

SQL = {
    "txt_t08_validation": f"""WITH v AS (SELECT raw_id, {case(CWE_TYPES, 'cwe_ids[1]', "''")} AS kind, lower(coalesce(severity, '')) AS sev, coalesce(end_line - start_line + 1, 0) AS line, coalesce(description, '') AS txt, len(string_split(coalesce(code_snippet, ''), chr(10))) AS n_lines,
  CASE lower(trim(confidence)) WHEN 'high' THEN 0.96 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.5 END AS conf FROM raw_findings),
 r AS (SELECT raw_id, CASE WHEN kind = '' THEN 'type' WHEN sev NOT IN ({', '.join(map(q, T.SEVERITIES))}) THEN 'severity' WHEN line < 0 OR line > 100000 THEN 'range' WHEN line > 0 AND line > n_lines THEN 'length' END AS unfit, {_RISK} AS risk FROM v)
 SELECT raw_id, coalesce(unfit, CASE WHEN risk >= 5 THEN 'suspicious' END) AS reason, CASE WHEN unfit IS NOT NULL THEN 0 ELSE risk END AS risk FROM r""",
    "txt_t10_message": f"""WITH m AS (SELECT 'f' || raw_id AS id, {_clean('description')} AS t FROM raw_findings UNION SELECT 'p' || id, {_clean('stdout_log')} FROM poc_runs)
 SELECT id, CASE WHEN length(t) > 500 THEN substring(t, 1, 500) || '...' ELSE t END AS message FROM m""",
    "txt_t13_families": f"SELECT {FAMILY} AS family, count(*) AS n FROM raw_findings GROUP BY 1",
    "txt_t14_weakness": f"SELECT raw_id, {case(T.SINK_SEVERITY, KIND, q('MEDIUM'))} AS severity, {case(T.SINK_CWE, KIND, q('CWE-707'))} AS cwe FROM raw_findings",
    "agg_a20_stride": f"""WITH s AS (SELECT unnest(string_split({case(T.TYPE_STRIDE, KIND, q('T'))}, '')) AS c FROM raw_findings), n AS (SELECT c, count(*) AS k FROM s GROUP BY 1)
 SELECT v.category, coalesce(k, 0) AS n FROM (VALUES {', '.join(f'({q(a)}, {q(b)})' for a, b in STRIDE_NAMES.items())}) v(c, category) LEFT JOIN n ON n.c = v.c""",
    "risk_r5_shares": f"""WITH p AS (SELECT project_id, {FAMILY} AS family, sum({_RANK}) AS w FROM raw_findings GROUP BY 1, 2), t AS (SELECT project_id, sum(w) AS total, max({{'w': w, 'f': family}}) AS m FROM p GROUP BY 1)
 SELECT project_id, m.f AS dominant, CASE WHEN total > 0 THEN round(m.w::double / total, 6) ELSE 0 END AS share FROM t""",
    "txt_t20_probe": f"""WITH b AS (SELECT id, unnest(string_split(regexp_replace(code, '[^{{}}]', '', 'g'), '')) AS x, generate_subscripts(string_split(regexp_replace(code, '[^{{}}]', '', 'g'), ''), 1) AS n FROM training_samples WHERE code IS NOT NULL),
 c AS (SELECT id, n, sum(CASE x WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS cum FROM b WINDOW w AS (PARTITION BY id ORDER BY n)),
 m AS (SELECT id, max(depth) AS depth FROM (SELECT id, cum - least(0, min(cum) OVER (PARTITION BY id ORDER BY n)) AS depth FROM c) GROUP BY 1),
 f AS (SELECT s.id, [{_N.format(q(T.PROBE['branches']))} + 1, len(string_split(code, chr(10))), {_N.format(q(T.PROBE['functions']))}, {_N.format(q(T.PROBE['loops']))}, coalesce(m.depth, 0)]::double[] AS v FROM training_samples s LEFT JOIN m ON m.id = s.id WHERE code IS NOT NULL),
 g AS (SELECT id, list_stddev_pop(v) AS std FROM f)
 SELECT id, round(std, 6) AS std, round(least(std / 5, 1), 6) AS confidence FROM g WHERE std > 2.5""",
    "txt_t21_features": f"""WITH l AS (SELECT id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM (SELECT id, string_split(code, chr(10)) AS x FROM training_samples WHERE code IS NOT NULL)),
 c AS (SELECT id, line, sum(len(regexp_extract_all(line, '\\{{')) - len(regexp_extract_all(line, '\\}}'))) OVER (PARTITION BY id ORDER BY n) AS cum FROM l),
 m AS (SELECT id, count(*) AS loc, greatest(0, max(cum)) AS depth, avg(length(line)) AS mean_len, max(length(line)) AS max_len FROM c GROUP BY 1),
 h AS (SELECT id, -sum(k / t * log2(k / t)) AS entropy FROM (SELECT id, ch, count(*)::double AS k, sum(count(*)) OVER (PARTITION BY id) AS t FROM (SELECT id, unnest(string_split(code, '')) AS ch FROM training_samples WHERE code IS NOT NULL) WHERE ch <> '' GROUP BY 1, 2) GROUP BY 1)
 SELECT s.id, round(least(loc / 1000, 1), 6) AS loc, round(least(depth / 10, 1), 6) AS nesting, {', '.join(f'round(least({_N.format(q(p))} / {n}, 1), 6) AS {name}' for name, (p, n) in T.COUNTED.items())},
  round({_N.format(q(T.COMMENT))} / loc, 6) AS comments, round(least(coalesce(entropy, 0) / 8, 1), 6) AS entropy, round(least(mean_len / 200, 1), 6) AS mean_line, round(least(max_len / 500, 1), 6) AS longest_line
 FROM training_samples s JOIN m ON m.id = s.id LEFT JOIN h ON h.id = s.id WHERE code IS NOT NULL""",
}


#: The rules that the test tables' types stand for.
RULE_OF = {"sql": "INJ-001", "cmd": "INJ-002", "xss": "INJ-005", "path": "INJ-006", "hardcoded": "AUTH-002", "buffer": "MEM-001"}


def txt_t19_locator(spark: SparkSession, d: str) -> DataFrame:
    conf = F.lower(F.trim("confidence"))
    number = F.when(conf == "high", 0.9).when(conf == "medium", 0.6).when(conf == "low", 0.3).otherwise(0.1)
    rows = table(spark, d, "raw_findings").select("raw_id", T.lookup(RULE_OF, kind_of(), F.lit("")).alias("rule"), F.col("title").alias("name"), F.col("cwe_ids").alias("cwes"), number.alias("confidence"), F.col("code_snippet").alias("text"))
    return locator.locate(rows, "raw_id").withColumn("confidence", F.round("confidence", 6))


QUERIES["txt_t19_locator"] = txt_t19_locator


def _list(xs: tuple[str, ...]) -> str:
    return "[" + ", ".join(q(x.lower()) for x in xs) + "]"


_INFERRED = " || ".join(f"CASE WHEN {' OR '.join(f'contains(nm, {q(p)})' for p in parts)} THEN {_list(ks)} ELSE [] END" for parts, ks in locator.NAME_KEYWORDS)
_KEYWORDS = "CASE rule " + " ".join(f"WHEN {q(r)} THEN {_list(ks)}" for r, ks in locator.RULE_KEYWORDS.items()) + f" ELSE CASE WHEN len({_INFERRED}) > 0 THEN {_INFERRED} ELSE {_list(locator.OTHER_KEYWORDS)} END END"
SQL["txt_t19_locator"] = rf"""WITH d AS (SELECT raw_id, {case(RULE_OF, KIND, "''")} AS rule, lower(coalesce(title, '')) AS nm, coalesce(cwe_ids, []) AS cwes, CASE lower(trim(confidence)) WHEN 'high' THEN 0.9 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0.1 END AS c, string_split(code_snippet, chr(10)) AS ls FROM raw_findings WHERE code_snippet IS NOT NULL),
 k AS (SELECT raw_id, {_KEYWORDS} AS k, cwes, c, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM d),
 s AS (SELECT *, round(len(list_filter(k, lambda x: contains(lower(line), x))) * 0.2 + CASE WHEN regexp_matches(line, {q(locator.INPUT)}) THEN 0.1 ELSE 0 END + len(list_filter(k, lambda x: contains(lower(regexp_extract(line, {q(locator.ASSIGNED)}, 2)), x))) * 0.15, 6)::double AS s,
   {' OR '.join(f"(len(list_filter(cwes, lambda x: contains(x, {q(p)}))) > 0 AND regexp_matches(line, {q(r)}))" for p, r in locator.SINK_LINES)} AS sink FROM k),
 b AS (SELECT raw_id, any_value(n) AS n, any_value(c) AS c, max(s) AS top, min(line_no) FILTER (WHERE s = best AND s > 0) AS at_line, min(line_no) FILTER (WHERE sink) AS sink FROM (SELECT *, max(s) OVER (PARTITION BY raw_id) AS best FROM s) GROUP BY 1)
 SELECT raw_id, CASE WHEN top > 0 THEN greatest(1, at_line - 3) ELSE coalesce(sink, 1) END AS start_line, CASE WHEN top > 0 THEN least(n, at_line + 3) ELSE coalesce(sink, least(n, 3)) END AS end_line,
  round((CASE WHEN top > 0 THEN least(1, c + top) WHEN sink IS NOT NULL THEN c * 0.7 ELSE c * 0.5 END)::double, 6) AS confidence, CASE WHEN top > 0 THEN 'scored' WHEN sink IS NOT NULL THEN 'sink' ELSE 'whole' END AS how FROM b"""
