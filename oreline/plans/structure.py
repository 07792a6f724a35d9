"""Graphs and metrics of the samples' source texts, with their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.operators import code, structure
from oreline.plans import code as code_plans
from oreline.plans.texts import q
from oreline.session import table


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return code_plans._code_lines(spark, d)


def join_j23_calls(spark: SparkSession, d: str) -> DataFrame:
    return structure.call_edges(_lines(spark, d), "id")


def graph_g14_entries(spark: SparkSession, d: str) -> DataFrame:
    return structure.entry_points(_lines(spark, d), "id")


def graph_g15_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return structure.call_edges(_lines(spark, d), "id").groupBy("id", "caller").agg(F.array_join(F.array_sort(F.collect_set("callee")), ",").alias("callees"))


def graph_g17_edges(spark: SparkSession, d: str) -> DataFrame:
    src = _lines(spark, d)
    blocks, events = code.basic_blocks(src, "id"), code.flow_events(src, "id")
    return structure.program_edges(blocks, events, src, "id", code.block_edges(blocks, "id"), code.def_use_chains(events, "id"))


def graph_g11_nodes(spark: SparkSession, d: str) -> DataFrame:
    blocks = code.basic_blocks(_lines(spark, d), "id")
    return structure.nodes_with_edges(blocks, code.block_edges(blocks, "id"), "id", "terminator", "branch")


def graph_g02_depth(spark: SparkSession, d: str) -> DataFrame:
    from oreline.operators.finding_text import deepest_floored

    return table(spark, d, "raw_findings").where("code_snippet is not null").select("raw_id", deepest_floored(F.col("code_snippet")).alias("depth"))


def flow_d1_reaching(spark: SparkSession, d: str) -> DataFrame:
    src = _lines(spark, d)
    return structure.reaching_definitions(code.flow_events(src, "id"), src.groupBy("id").agg(F.max("line_no").alias("n_lines")), "id")


def flow_d6_used(spark: SparkSession, d: str) -> DataFrame:
    return structure.used_lines(code.def_use_chains(code.flow_events(_lines(spark, d), "id"), "id"), "id")


def flow_c8_metrics(spark: SparkSession, d: str) -> DataFrame:
    return structure.code_metrics(table(spark, d, "training_samples"), "id", "code")


def _structure(spark: SparkSession, d: str) -> DataFrame:
    blocks = code.basic_blocks(_lines(spark, d), "id")
    return structure.flow_structure(blocks, code.block_edges(blocks, "id"), "id")


def flow_c3_dominators(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d).select("id", "block", "idom")


def flow_c4_loops(spark: SparkSession, d: str) -> DataFrame:
    return _structure(spark, d).groupBy("id").agg(F.max("loop_depth").alias("max_loop_depth"), F.count_if(~F.col("reachable")).alias("n_unreachable"), F.sum("n_frontier").alias("n_frontier"))


def txt_t03_matches(spark: SparkSession, d: str) -> DataFrame:
    return structure.text_matches(table(spark, d, "raw_findings"), "raw_id", "code_snippet").groupBy("raw_id", "type", "line_no").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (join_j23_calls, graph_g14_entries, graph_g15_adjacency, graph_g17_edges, graph_g11_nodes, graph_g02_depth, flow_d1_reaching, flow_d6_used, flow_c8_metrics, flow_c3_dominators, flow_c4_loops, txt_t03_matches)}

_DEF = r"\b(?:def|function|func)\s+([A-Za-z_]\w*)"
_FUNCTIONS = rf"fn AS (SELECT id, name, max(line_no) AS line_no FROM (SELECT id, line_no, regexp_extract(line, '{_DEF}', 1) AS name FROM l) WHERE name <> '' GROUP BY 1, 2)"
_CALLS = rf"""{code_plans._CODE}, {_FUNCTIONS},
 sc AS (SELECT id, line, nullif(regexp_extract(line, '{_DEF}', 1), '') AS begun, coalesce(last_value(nullif(regexp_extract(line, '{_DEF}', 1), '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY line_no), 'global') AS caller FROM l),
 nm AS (SELECT id, caller, begun, unnest(regexp_extract_all(line, '\b([A-Za-z_]\w*)\s*\(', 1)) AS callee FROM sc),
 ce AS (SELECT nm.id, caller, callee, count(*) AS n_calls FROM nm SEMI JOIN fn ON fn.id = nm.id AND fn.name = nm.callee WHERE callee NOT IN ({', '.join(map(q, structure.NO_CALLS))}) AND callee IS DISTINCT FROM begun GROUP BY 1, 2, 3)"""
_DEPTH = """b AS (SELECT {k} AS k, unnest(string_split(regexp_replace({t}, '[^{{}}]', '', 'g'), '')) AS x, generate_subscripts(string_split(regexp_replace({t}, '[^{{}}]', '', 'g'), ''), 1) AS n FROM {s} WHERE {t} IS NOT NULL),
 c AS (SELECT k, n, sum(CASE x WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS cum FROM b),
 m AS (SELECT k, max(depth) AS depth FROM (SELECT k, cum - least(0, min(cum) OVER (PARTITION BY k ORDER BY n)) AS depth FROM c) GROUP BY 1)"""

SQL = {
    "join_j23_calls": f"WITH {_CALLS} SELECT * FROM ce",
    "graph_g14_entries": rf"WITH {_CALLS} SELECT fn.id, fn.name, fn.line_no FROM fn WHERE regexp_matches(name, '(?i)^(?:handle|on[A-Z_]|main|get|post|put|delete|patch|run|process|execute|dispatch)') OR NOT EXISTS (SELECT 1 FROM ce WHERE ce.id = fn.id AND ce.callee = fn.name AND ce.caller <> ce.callee)",
    "graph_g15_adjacency": f"WITH {_CALLS} SELECT id, caller, string_agg(callee, ',' ORDER BY callee) AS callees FROM ce GROUP BY 1, 2",
    "graph_g17_edges": f"WITH {code_plans._BLOCKS}, {_CALLS.removeprefix(code_plans._CODE + ', ')}, {code_plans._EVENTS.removeprefix(code_plans._CODE + ',')}, ch AS (SELECT u.id, u.var, u.line_no, max(d.line_no) AS def_line FROM ev u JOIN ev d ON d.is_def AND d.id = u.id AND d.var = u.var AND d.line_no < u.line_no WHERE NOT u.is_def GROUP BY 1, 2, 3) SELECT id, 'CFG' AS kind, count(*) AS n FROM ed GROUP BY 1 UNION ALL SELECT id, 'DFG', count(*) FROM ch GROUP BY 1 UNION ALL SELECT id, 'CALL', sum(n_calls) FROM ce GROUP BY 1",
    "graph_g11_nodes": f"WITH {code_plans._BLOCKS}, i AS (SELECT id, dst AS node, count(*) AS n FROM ed GROUP BY 1, 2), o AS (SELECT id, src AS node, count(*) AS n FROM ed GROUP BY 1, 2) SELECT bb.id, start_line AS node, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM bb LEFT JOIN i ON i.id = bb.id AND i.node = start_line LEFT JOIN o ON o.id = bb.id AND o.node = start_line WHERE terminator = 'branch'",
    "graph_g02_depth": f"WITH {_DEPTH.format(k='raw_id', t='code_snippet', s='raw_findings')} SELECT raw_id, coalesce(depth, 0) AS depth FROM raw_findings LEFT JOIN m ON m.k = raw_id WHERE code_snippet IS NOT NULL",
    "flow_d1_reaching": f"WITH {code_plans._EVENTS}, n AS (SELECT id, max(line_no) AS n_lines FROM l GROUP BY 1), d AS (SELECT id, var, line_no, lead(line_no) OVER (PARTITION BY id, var ORDER BY line_no) AS nx FROM (SELECT DISTINCT id, var, line_no FROM ev WHERE is_def)) SELECT d.id, var, line_no AS def_line, line_no + 1 AS from_line, coalesce(nx, n_lines) AS to_line FROM d JOIN n ON n.id = d.id WHERE line_no + 1 <= coalesce(nx, n_lines)",
    "flow_d6_used": f"WITH {code_plans._EVENTS}, ch AS (SELECT u.id, u.var, u.line_no, max(d.line_no) AS def_line FROM ev u LEFT JOIN ev d ON d.is_def AND d.id = u.id AND d.var = u.var AND d.line_no < u.line_no WHERE NOT u.is_def GROUP BY 1, 2, 3) SELECT id, line_no, count(*) AS n_vars, count(def_line) AS n_defined, max(def_line) AS nearest FROM ch GROUP BY 1, 2",
    "flow_c8_metrics": rf"WITH {_DEPTH.format(k='id', t='code', s='training_samples')} SELECT id, len(string_split(code, chr(10))) AS loc, len(regexp_extract_all(code, '{_DEF}')) AS functions, coalesce(depth, 0) AS depth, len(regexp_extract_all(code, '\b(if|for|while|case|catch|elif|except)\b')) + 1 AS decisions, 0.2::double AS anomaly FROM training_samples LEFT JOIN m ON m.k = id WHERE code IS NOT NULL",
}
