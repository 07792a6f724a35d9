"""Text and code analyses over the samples, snippets, scripts and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import code, rules
from oreline.session import table


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _code_lines(spark: SparkSession, d: str) -> DataFrame:
    return code.lines(table(spark, d, "training_samples"), "id", "code")


def txt_t01_rules(spark: SparkSession, d: str) -> DataFrame:
    return code.rule_hits(code.lines(table(spark, d, "raw_findings"), "raw_id", "code_snippet"), "raw_id")


def txt_t04_weak(spark: SparkSession, d: str) -> DataFrame:
    return code.typed_hits(code.lines(table(spark, d, "raw_findings"), "raw_id", "code_snippet"), "raw_id", rules.WEAK_RULES)


def txt_t05_markup(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    for p in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        text = F.regexp_replace(text, p, "")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(text).cast("bigint").alias("n_left"))


def txt_t06_redact(spark: SparkSession, d: str) -> DataFrame:
    text, n = code.redact(F.col("poc_script"))
    return table(spark, d, "poc_runs").where("poc_script is not null").select("id", F.sha2(text, 256).alias("digest"), n.cast("bigint").alias("n_redacted")).distinct()


def txt_t07_injection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", code.injection_score(F.col("text")).cast("bigint").alias("risk")).where("risk > 0")


def txt_t12_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat_ws("|", F.coalesce("rule_id", F.lit("")), F.coalesce("file_path", F.lit("")), F.coalesce(F.col("start_line").cast("string"), F.lit("")))
    return table(spark, d, "raw_findings").select("raw_id", F.substring(F.sha2(payload, 256), 1, 32).alias("fingerprint"))


def txt_t11_severity(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.coalesce("severity", F.lit("")))
    tool = F.when(s.isin("critical", "error", "blocker"), "CRITICAL").when(s.isin("high", "warning"), "HIGH").when(s.isin("medium", "moderate"), "MEDIUM").otherwise("LOW")
    level = F.when(tool.isin("CRITICAL", "HIGH"), "error").when(tool == "MEDIUM", "warning").otherwise("note")
    return table(spark, d, "raw_findings").groupBy(tool.alias("severity"), level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def txt_t15_assignments(spark: SparkSession, d: str) -> DataFrame:
    src = _code_lines(spark, d)
    name = F.coalesce(F.nullif(F.regexp_extract("line", r"^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*(\$\w+)\s*=", 1), F.lit("")), F.nullif(F.regexp_extract("line", r"^\s*([A-Za-z_]\w*)\s*=[^=]", 1), F.lit("")))
    return src.select("id", "line_no", name.alias("target")).where("target is not null")


def txt_t16_scopes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    src = _code_lines(spark, d)
    start = F.nullif(F.regexp_extract("line", r"^\s*(?:async\s+)?(?:def|function)\s+([A-Za-z_]\w*)", 1), F.lit(""))
    w = Window.partitionBy("id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return src.select("id", "line_no", F.coalesce(F.last(start, True).over(w), F.lit("global")).alias("scope")).groupBy("id", "scope").agg(F.count(F.lit(1)).alias("n_lines"))


def txt_t24_payload(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    payload = F.concat_ws("|", F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string"), F.coalesce("props", F.lit("{}")))
    return e.select("event_id", F.sha2(payload, 256).alias("hash"))


def win_w5_overlap(spark: SparkSession, d: str) -> DataFrame:
    return code.context_overlap(_code_lines(spark, d), "id").select("id", "line_no", F.round("overlap", 6).alias("overlap"))


def win_w6_context(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    src = code.lines(table(spark, d, "raw_findings"), "raw_id", "code_snippet")
    w = Window.partitionBy("raw_id").orderBy("line_no").rowsBetween(-9, 2)
    return src.select("raw_id", "line_no", F.sha2(F.array_join(F.collect_list("line").over(w), "\n"), 256).alias("context"))


def win_w9_nesting(spark: SparkSession, d: str) -> DataFrame:
    return code.nesting(_code_lines(spark, d), "id")


def flow_d3_chains(spark: SparkSession, d: str) -> DataFrame:
    return code.def_use_chains(code.flow_events(_code_lines(spark, d), "id"), "id")


def flow_d2_live(spark: SparkSession, d: str) -> DataFrame:
    return code.live_variables(code.flow_events(_code_lines(spark, d), "id"), "id")


def flow_d4_dead(spark: SparkSession, d: str) -> DataFrame:
    return code.dead_stores(code.flow_events(_code_lines(spark, d), "id"), "id")


def flow_d4_unset(spark: SparkSession, d: str) -> DataFrame:
    return code.def_use_chains(code.flow_events(_code_lines(spark, d), "id"), "id").where("def_line is null").groupBy("id", "var").agg(F.min("use_line").alias("first_use"), F.count(F.lit(1)).alias("n_uses"))


def flow_c1_blocks(spark: SparkSession, d: str) -> DataFrame:
    return code.basic_blocks(_code_lines(spark, d), "id").select("id", "start_line", "end_line", "terminator")


def flow_c2_edges(spark: SparkSession, d: str) -> DataFrame:
    return code.block_edges(code.basic_blocks(_code_lines(spark, d), "id"), "id")


def flow_c5_cyclomatic(spark: SparkSession, d: str) -> DataFrame:
    blocks = code.basic_blocks(_code_lines(spark, d), "id")
    e = code.block_edges(blocks, "id").groupBy("id").agg(F.count(F.lit(1)).alias("e"))
    return blocks.groupBy("id").agg(F.count(F.lit(1)).alias("n")).join(e, "id", "left").select("id", "n", F.greatest(F.lit(1), F.coalesce("e", F.lit(0)) - F.col("n") + 2).alias("cyclomatic"))


def _marks(spark: SparkSession, d: str) -> DataFrame:
    return code.taint_marks(code.lines(table(spark, d, "raw_findings"), "raw_id", "code_snippet"), "raw_id")


def taint_x13_marks(spark: SparkSession, d: str) -> DataFrame:
    n = lambda c: F.size(c).cast("bigint").alias("n_" + c)
    return _marks(spark, d).select("raw_id", "line_no", "var", n("sources"), n("sinks"), n("cleans"))


def taint_x9_paths(spark: SparkSession, d: str) -> DataFrame:
    return code.taint_paths(_marks(spark, d), "raw_id").withColumn("confidence", F.round("confidence", 6))


def taint_x6_result(spark: SparkSession, d: str) -> DataFrame:
    return code.taint_paths(_marks(spark, d), "raw_id").groupBy("raw_id").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.max(F.col("confidence") >= 0.6).alias("tainted"), F.count(F.lit(1)).alias("n_paths"))


def taint_x10_sinks(spark: SparkSession, d: str) -> DataFrame:
    return code.sink_confidence(_marks(spark, d), "raw_id").withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (
    txt_t01_rules, txt_t04_weak, txt_t05_markup, txt_t06_redact, txt_t07_injection, txt_t11_severity, txt_t12_fingerprint, txt_t15_assignments, txt_t16_scopes, txt_t24_payload,
    win_w5_overlap, win_w6_context, win_w9_nesting, flow_d2_live, flow_d3_chains, flow_d4_dead, flow_d4_unset, flow_c1_blocks, flow_c2_edges, flow_c5_cyclomatic, taint_x13_marks, taint_x9_paths, taint_x6_result, taint_x10_sinks,
)}

_SNIP = "l AS (SELECT raw_id, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT raw_id, string_split(code_snippet, chr(10)) AS x FROM raw_findings WHERE code_snippet IS NOT NULL))"
_CODE = "l AS (SELECT id, generate_subscripts(x, 1) AS line_no, unnest(x) AS line FROM (SELECT id, string_split(code, chr(10)) AS x FROM training_samples WHERE code IS NOT NULL))"
_RULES = ", ".join(f"({_lit(i)}, {_lit(s)}, {c}, {_lit(p)})" for i, s, c, p in rules.LINE_RULES)
_STOP = ", ".join(_lit(w) for w in rules.NOT_VARIABLES)
_HEAD = _lit(code.HEADER)
# RE2 has no lookahead: an assignment is matched with the character after it, or at the line's end
_ASSIGNED = r"list_transform(regexp_extract_all(regexp_replace(line, '==+', '~~', 'g'), '\b([A-Za-z_$][\w$]*)\s*=', 1), lambda x: x)"
_EVENTS = rf"""{_CODE},
 a AS (SELECT id, line_no, line, CASE WHEN regexp_matches(line, {_HEAD}) THEN [] ELSE {_ASSIGNED} END AS defs, regexp_extract_all(line, '\b([A-Za-z_$][\w$]*)\b', 1) AS names FROM l),
 ev AS (SELECT DISTINCT id, line_no, var, true AS is_def FROM (SELECT id, line_no, unnest(defs) AS var FROM a) WHERE var NOT IN ({_STOP})
  UNION ALL SELECT DISTINCT id, line_no, var, false FROM (SELECT id, line_no, unnest(list_filter(names, lambda n: NOT list_contains(defs, n))) AS var FROM a) WHERE var NOT IN ({_STOP}))"""
_BLOCKS = rf"""{_CODE},
 p AS (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY line_no) AS prev FROM l),
 n AS (SELECT *, CASE WHEN prev IS NULL OR (regexp_matches(trim(prev), '^\s*[\}}\]]?\s*[\}}\]]?\s*$') AND regexp_matches(line, '^\s*[^\s\}}\]]')) OR (regexp_matches(prev, {_lit(code.BRANCH)}) AND NOT regexp_matches(prev, '^\s*(\}}|\)|;?\s*$)'))
   OR (regexp_matches(prev, {_lit(code.BRANCH)}) AND regexp_matches(prev, '\b(if|for|while|case|default)\b')) THEN 1 ELSE 0 END AS leader FROM p),
 m AS (SELECT *, sum(leader) OVER (PARTITION BY id ORDER BY line_no) AS block FROM n),
 b AS (SELECT id, block, min(line_no) AS start_line, max(line_no) AS end_line, trim(arg_max(line, line_no), ' ') AS t FROM m GROUP BY id, block),
 bb AS (SELECT *, CASE WHEN regexp_matches(t, '^return\b') THEN 'return' WHEN regexp_matches(t, '^throw\b') THEN 'throw' WHEN regexp_matches(t, '^continue\b') THEN 'continue' WHEN regexp_matches(t, '^break\b') THEN 'break' WHEN regexp_matches(t, '\b(if|else\s+if|for|while|switch)\b') THEN 'branch' ELSE 'fallthrough' END AS terminator,
   CASE WHEN regexp_matches(t, '\bif\b') THEN 'if' WHEN regexp_matches(t, '\b(for|while)\b') THEN 'loop' ELSE 'other' END AS kind, lead(start_line, 1) OVER w AS one, lead(start_line, 2) OVER w AS two FROM b WINDOW w AS (PARTITION BY id ORDER BY start_line)),
 ed AS (SELECT id, start_line AS src, one AS dst, CASE WHEN terminator IN ('continue', 'break') THEN 'unconditional' WHEN terminator = 'fallthrough' THEN 'fallthrough' WHEN kind IN ('if', 'loop') THEN 'branch_true' ELSE 'unconditional' END AS edge FROM bb WHERE terminator NOT IN ('return', 'throw') AND one IS NOT NULL
  UNION ALL SELECT id, start_line, two, 'branch_false' FROM bb WHERE terminator = 'branch' AND kind IN ('if', 'loop') AND two IS NOT NULL
  UNION ALL SELECT id, one, start_line, 'loop_back' FROM bb WHERE terminator = 'branch' AND kind = 'loop' AND one IS NOT NULL)"""


def _values(t) -> str:
    return ", ".join(f"({k}, {_lit(kind)}, {_lit(p)}, {c})" for k, (kind, p, c) in enumerate(t))


_TAINT = rf"""{_SNIP},
 v AS (SELECT raw_id, line_no, line, coalesce(nullif(regexp_extract(regexp_replace(line, '==+', '~~', 'g'), '\b([A-Za-z_$][\w$]*)\s*=', 1), ''), CASE WHEN regexp_matches(line, 'function\s+\w+\s*\(([^)]*)\)') THEN string_split_regex(trim(string_split(regexp_extract(line, 'function\s+\w+\s*\(([^)]*)\)', 1), ',')[1]), '\s+')[1] END) AS var FROM l),
 so AS (SELECT raw_id, line_no, var, o, type, c FROM v JOIN (VALUES {_values(rules.SOURCES)}) t(o, type, p, c) ON regexp_matches(line, p)),
 si AS (SELECT raw_id, line_no, var, o, type, c FROM v JOIN (VALUES {_values(rules.SINKS)}) t(o, type, p, c) ON regexp_matches(line, p)),
 sa AS (SELECT raw_id, line_no, var, o, type, c FROM v JOIN (VALUES {_values(rules.SANITIZERS)}) t(o, type, p, c) ON regexp_matches(line, p))"""
_PATHS = f"""{_TAINT},
 pairs AS (SELECT so.raw_id, so.line_no AS source_line, si.line_no AS sink_line, so.type AS source_type, si.type AS sink_type, so.c * si.c AS base, si.var, row_number() OVER (PARTITION BY so.raw_id ORDER BY so.line_no, so.o, si.line_no, si.o) AS rn
   FROM so JOIN si ON si.raw_id = so.raw_id AND si.line_no > so.line_no AND si.line_no - so.line_no <= 200),
 paths AS (SELECT p.raw_id, source_line, sink_line, source_type, sink_type, greatest(0.1, any_value(base) * (1 - least(0.95, coalesce(sum(sa.c), 0)))) AS confidence, sink_line - source_line AS distance
   FROM pairs p LEFT JOIN sa ON sa.raw_id = p.raw_id AND sa.line_no > p.source_line AND sa.line_no < p.sink_line AND sa.var IS NOT DISTINCT FROM p.var WHERE rn <= 50 GROUP BY p.raw_id, rn, source_line, sink_line, source_type, sink_type)"""


def _redaction() -> str:
    out, last = "r0 AS (SELECT DISTINCT id, poc_script AS t, 0 AS n FROM poc_runs WHERE poc_script IS NOT NULL)", "r0"
    for k, (_, p) in enumerate(rules.SECRETS, 1):
        out += f", r{k} AS (SELECT id, regexp_replace(t, {_lit(p)}, '***REDACTED***', 'g') AS t, n + len(regexp_extract_all(t, {_lit(p)})) AS n FROM {last})"
        last = f"r{k}"
    return f"WITH {out} SELECT DISTINCT id, sha256(t) AS digest, n AS n_redacted FROM {last}"


SQL = {
    "txt_t01_rules": f"WITH {_SNIP} SELECT raw_id, line_no, rule_id, severity, confidence, length(regexp_extract(line, '(?is)^(.*?)(?:' || p || ')', 1)) AS col FROM l JOIN (VALUES {_RULES}) r(rule_id, severity, confidence, p) ON regexp_matches(line, p, 'i')",
    "txt_t04_weak": f"WITH {_SNIP} SELECT DISTINCT raw_id, line_no, type FROM l JOIN (VALUES {', '.join(f'({_lit(t)}, {_lit(p)})' for t, p in rules.WEAK_RULES)}) r(type, p) ON regexp_matches(line, p)",
    "txt_t05_markup": "SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS n_left FROM documents WHERE text IS NOT NULL",
    "txt_t06_redact": _redaction(),
    "txt_t07_injection": "SELECT * FROM (SELECT doc_id, " + " + ".join(f"CASE WHEN regexp_matches(text, {_lit('(?i)' + p)}) THEN {w} ELSE 0 END" for _, w, p in rules.INJECTIONS) + " AS risk FROM documents) WHERE risk > 0",
    "txt_t11_severity": "WITH s AS (SELECT CASE WHEN lower(severity) IN ('critical', 'error', 'blocker') THEN 'CRITICAL' WHEN lower(severity) IN ('high', 'warning') THEN 'HIGH' WHEN lower(severity) IN ('medium', 'moderate') THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM raw_findings) SELECT severity, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM s GROUP BY 1, 2",
    "txt_t12_fingerprint": "SELECT raw_id, substring(sha256(coalesce(rule_id, '') || '|' || coalesce(file_path, '') || '|' || coalesce(start_line::varchar, '')), 1, 32) AS fingerprint FROM raw_findings",
    "txt_t15_assignments": rf"WITH {_CODE} SELECT * FROM (SELECT id, line_no, coalesce(nullif(regexp_extract(line, '^\s*(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=', 1), ''), nullif(regexp_extract(line, '^\s*(\$\w+)\s*=', 1), ''), nullif(regexp_extract(line, '^\s*([A-Za-z_]\w*)\s*=[^=]', 1), '')) AS target FROM l) WHERE target IS NOT NULL",
    "txt_t16_scopes": rf"WITH {_CODE}, s AS (SELECT id, coalesce(last_value(nullif(regexp_extract(line, '^\s*(?:async\s+)?(?:def|function)\s+([A-Za-z_]\w*)', 1), '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no), 'global') AS scope FROM l) SELECT id, scope, count(*) AS n_lines FROM s GROUP BY id, scope",
    "txt_t24_payload": "SELECT event_id, sha256(event_id::varchar || '|' || event_type || '|' || user_id::varchar || '|' || coalesce(props, '{}')) AS hash FROM events",
    "win_w5_overlap": rf"""WITH {_CODE}, t AS (SELECT id, line_no, list_transform(regexp_extract_all(line, '\b([A-Za-z_$][\w$]*)\b', 1), lambda x: lower(x)) AS toks FROM l),
 n AS (SELECT *, list_concat(coalesce(flatten(list(toks) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), []), coalesce(flatten(list(toks) OVER (PARTITION BY id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), [])) AS near FROM t)
 SELECT id, line_no, CASE WHEN len(toks) > 0 AND len(near) > 0 THEN round(len(list_intersect(list_distinct(toks), list_distinct(near)))::double / len(list_distinct(list_concat(toks, near))), 6) ELSE 0 END AS overlap FROM n""",
    "win_w6_context": f"WITH {_SNIP} SELECT raw_id, line_no, sha256(string_agg(line, chr(10)) OVER (PARTITION BY raw_id ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND 2 FOLLOWING)) AS context FROM l",
    "win_w9_nesting": rf"WITH {_CODE}, s AS (SELECT id, line_no, sum(len(regexp_extract_all(line, '\{{')) - len(regexp_extract_all(line, '\}}'))) OVER (PARTITION BY id ORDER BY line_no) AS cum FROM l), f AS (SELECT *, least(0, min(cum) OVER (PARTITION BY id ORDER BY line_no)) AS low FROM s) SELECT id, greatest(0, max(cum)) AS deepest, max(cum - low) AS deepest_floored FROM f GROUP BY id",
    "flow_d3_chains": f"WITH {_EVENTS} SELECT u.id, u.var, u.line_no AS use_line, max(d.line_no) AS def_line FROM ev u LEFT JOIN ev d ON d.is_def AND d.id = u.id AND d.var = u.var AND d.line_no < u.line_no WHERE NOT u.is_def GROUP BY 1, 2, 3",
    "flow_d2_live": f"WITH {_EVENTS}, k AS (SELECT DISTINCT id, var, line_no FROM ev) SELECT k.id, k.line_no, k.var FROM k JOIN ev x ON x.id = k.id AND x.var = k.var AND x.line_no >= k.line_no GROUP BY ALL HAVING min(CASE WHEN NOT x.is_def THEN x.line_no END) IS NOT NULL AND (min(CASE WHEN x.is_def THEN x.line_no END) IS NULL OR min(CASE WHEN NOT x.is_def THEN x.line_no END) <= min(CASE WHEN x.is_def THEN x.line_no END))",
    "flow_d4_dead": f"WITH {_EVENTS} SELECT d.id, d.var, d.line_no FROM ev d LEFT JOIN ev x ON x.id = d.id AND x.var = d.var AND x.line_no > d.line_no WHERE d.is_def GROUP BY ALL HAVING min(CASE WHEN NOT x.is_def THEN x.line_no END) IS NULL OR min(CASE WHEN NOT x.is_def THEN x.line_no END) > min(CASE WHEN x.is_def THEN x.line_no END)",
    "flow_d4_unset": f"WITH {_EVENTS}, c AS (SELECT u.id, u.var, u.line_no AS use_line, max(d.line_no) AS def_line FROM ev u LEFT JOIN ev d ON d.is_def AND d.id = u.id AND d.var = u.var AND d.line_no < u.line_no WHERE NOT u.is_def GROUP BY 1, 2, 3) SELECT id, var, min(use_line) AS first_use, count(*) AS n_uses FROM c WHERE def_line IS NULL GROUP BY 1, 2",
    "flow_c1_blocks": f"WITH {_BLOCKS} SELECT id, start_line, end_line, terminator FROM bb",
    "flow_c2_edges": f"WITH {_BLOCKS} SELECT * FROM ed",
    "flow_c5_cyclomatic": f"WITH {_BLOCKS}, e AS (SELECT id, count(*) AS e FROM ed GROUP BY id) SELECT bb.id, count(*) AS n, greatest(1, coalesce(any_value(e.e), 0) - count(*) + 2) AS cyclomatic FROM bb LEFT JOIN e ON e.id = bb.id GROUP BY bb.id",
    "taint_x13_marks": f"WITH {_TAINT}, k AS (SELECT raw_id, line_no, var, 1 AS a, 0 AS b, 0 AS c FROM so UNION ALL SELECT raw_id, line_no, var, 0, 1, 0 FROM si UNION ALL SELECT raw_id, line_no, var, 0, 0, 1 FROM sa) SELECT raw_id, line_no, var, sum(a) AS n_sources, sum(b) AS n_sinks, sum(c) AS n_cleans FROM k GROUP BY 1, 2, 3",
    "taint_x9_paths": f"WITH {_PATHS} SELECT raw_id, source_line, sink_line, source_type, sink_type, round(confidence::double, 6) AS confidence, distance FROM paths",
    "taint_x6_result": f"WITH {_PATHS} SELECT raw_id, round(max(confidence)::double, 6) AS confidence, bool_or(confidence >= 0.6) AS tainted, count(*) AS n_paths FROM paths GROUP BY raw_id",
    "taint_x10_sinks": f"WITH {_TAINT}, k AS (SELECT raw_id, line_no, arg_min(c, o) AS sc FROM si GROUP BY 1, 2), n AS (SELECT raw_id, line_no, arg_max(c, o) AS nc FROM so GROUP BY 1, 2), j AS (SELECT k.raw_id, k.line_no, any_value(sc) AS sc, max(n.line_no) AS near, arg_max(nc, n.line_no) AS nc FROM k JOIN n ON n.raw_id = k.raw_id AND n.line_no < k.line_no GROUP BY 1, 2), z AS (SELECT raw_id, line_no, sum(c) AS cut FROM sa GROUP BY 1, 2) SELECT j.raw_id, j.line_no, round(greatest(0.1, nc::double * sc::double * exp(-(j.line_no - near) / 50.0) * (1 - least(0.95, coalesce(cut, 0)))), 6) AS confidence FROM j LEFT JOIN z ON z.raw_id = j.raw_id AND z.line_no = j.line_no",
}
