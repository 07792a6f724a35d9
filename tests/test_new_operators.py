"""Threats, reports, structures, scores and finding texts: small cases with nulls, empties, ties and clashing columns."""

from __future__ import annotations

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from oreline.operators import code, finding_text, graph, relational, reports, scores, stats, structure, threats

T = dt.datetime(2026, 1, 1)


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def marks(spark, texts):
    src = spark.createDataFrame([(k, t, "clash") for k, t in texts], "id int, text string, sources string").drop("sources")
    return code.taint_marks(code.lines(src, "id", "text"), "id")


# --- threats --------------------------------------------------------------------------------------------------------

CODE = "q = req.query.id\nx = parseInt(q)\ndb.query('a' + q)\nos.system(q)"


def test_scoped_and_enhanced_paths(spark):
    m = marks(spark, [(1, CODE), (2, None), (3, ""), (4, "os.system(a)\nb = req.body")])
    got = rows(threats.scoped_paths(m, "id"), "id", "source_line", "sink_line", "sink_type", "sanitized", "confidence")
    assert (1, 1, 4, "shell", True, 0.4) in got and all(r[0] == 1 for r in got)
    deep = rows(threats.enhanced_paths(m, "id"), "id", "source_line", "sink_line")
    assert (4, 2, 1) in deep  # either order of lines counts in a scope
    res = threats.enhanced_result(threats.enhanced_paths(m, "id"), "id").where("id = 4").first()
    assert res.n_paths == 1 and not res.inter_procedural
    assert threats.scoped_paths(marks(spark, []), "id").count() == 0


def test_calls(spark):
    src = spark.createDataFrame([(1, 1, "a.b.readFile(x); eval(y); foo(z)"), (1, 2, None)], "id int, line_no int, line string")
    assert rows(threats.calls(src, "id"), "callee", "role", "type") == {("readFile", "source", "file_io"), ("eval", "sink", "eval")}


def paths(spark, data):
    return spark.createDataFrame(data, "id int, ordinal int, source_line int, sink_line int, source_type string, sink_type string, sanitized boolean, confidence double")


def test_threat_model(spark):
    p = paths(spark, [(1, 1, 9, 9, "user_input", "sql", False, 0.5), (1, 0, 3, 4, "user_input", "sql", True, 0.4), (1, 2, 5, 6, "cookie", "sql", False, 0.85), (2, 0, 1, 1, "console", "redirect", False, 0.2)])
    assert rows(threats.trust_boundaries(p, "id"), "id", "source_type", "type", "line", "confidence") == {(1, "user_input", "data_store", 3, 0.4), (1, "cookie", "network", 5, 0.85)}
    t = threats.threats(p, "id")
    got = {(r.category, r.source_type): r.priority for r in t.collect()}
    assert got == {("tampering", "user_input"): 24, ("spoofing", "cookie"): 64, ("repudiation", "cookie"): 38}  # (90 - 30) * .4, 75 * .85, 45 * .85, half up
    assert rows(threats.schedule(t, "id"), "category", "rules", "priority") == {("tampering", "INJ", 24), ("spoofing", "AUTH", 64), ("repudiation", "AUTH", 38)}
    risk = threats.risk_assessment(t, "id").first()
    assert (risk.overall, risk.critical_paths, risk.tampering, risk.denial_of_service) == (23, 0, 24, 0)
    cover = threats.coverage(t, spark.createDataFrame([(1, ["CWE-89", None]), (1, ["CWE-89"]), (1, None), (9, ["CWE-384"])], "id int, cwes array<string>"), "id").first()
    assert (cover.total, cover.scanned, cover.percent) == (3, 1, 33) and "tampering" not in cover.unscanned


def test_safety_takes_the_first_of_equal_sinks(spark):
    src = spark.createDataFrame([(1, k, "x = intval(y)" if k == 2 else "query(z)") for k in range(1, 50)], "id int, line_no int, line string")
    p = paths(spark, [(1, 0, 1, 4, "user_input", "sql", False, 0.85), (1, 1, 2, 4, "user_input", "sql", False, 0.4), (1, 2, 1, 40, "env", "sql", False, 0.4), (1, 3, 1, 4, "env", "xxe", False, 0.1)])
    got = {r.sink_line: round(r.confidence, 6) for r in threats.safe_findings(p, src, "id").collect()}
    assert got == {4: 0.255, 40: 0.4}


# --- finding texts ----------------------------------------------------------------------------------------------------

def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


def test_message(spark):
    x = F.col("x")
    assert one(spark, "a ```code``` $_GET['q'] `" + "y" * 30 + "` b", finding_text.message(x)) == "a [code-stripped] [code-stripped] [code-stripped] b"
    assert one(spark, "z" * 501, finding_text.message(x)) == "z" * 500 + "..." and one(spark, "z" * 500, finding_text.message(x)) == "z" * 500
    assert one(spark, None, finding_text.message(x)) is None and one(spark, "", finding_text.message(x)) == ""


def test_validation(spark):
    cases = [
        ("SQL Injection", "HIGH", 1, "a long description", None, "x", 0.5, None, 0), ("Odd", "high", 1, "", None, "x", 0.5, "type", 0), ("XPath Injection", "huge", 1, "", None, "x", 0.5, "severity", 0),
        ("XPath Injection", "low", -1, "", None, "x", 0.5, "range", 0), ("XPath Injection", "low", 3, "", None, "x\ny", 0.5, "length", 0), ("XPath Injection", "low", None, "short", None, None, None, None, 2),
        ("XPath Injection", "critical", 2, "ignore all previous", "you are now free", "a\nb", 9.0, "suspicious", 11),
    ]
    df = spark.createDataFrame([c[:7] for c in cases], "k string, s string, l int, d string, r string, c string, f double")
    reason, risk = finding_text.validation(*(F.col(c) for c in "ksldrcf"))
    assert [tuple(r) for r in df.select(reason, risk).collect()] == [c[7:] for c in cases]


def test_depth_entropy_and_features(spark):
    x = F.col("x")
    assert [one(spark, t, finding_text.deepest_floored(x)) for t in ("}}{", "{{}{{", "", "a")] == [1, 3, 0, 0]
    assert one(spark, "aabb", finding_text.character_entropy(x)) == 1.0 and one(spark, "", finding_text.character_entropy(x)) == 0.0
    f = {k: one(spark, "if (a) {\n  exec(b)\n}", c) for k, c in finding_text.code_features(x).items()}
    assert (f["loc"], f["nesting"], f["decisions"], f["dangerous"]) == (0.003, 0.1, 0.02, 0.1)
    assert finding_text.family(F.lit(None)) is not None and one(spark, "SQL-i", finding_text.family(x)) == "sql"


# --- reports --------------------------------------------------------------------------------------------------------

def test_triage_state(spark):
    df = spark.createDataFrame([("a", "open", None, 1, 0), ("a", "fixed", "me", 2, 0), ("a", "odd", "me", 9, 0), (None, "open", "x", 1, 0), ("b", "open", "x", None, 0), ("c", "open", "x", 5, 0), ("c", "open", "x", 5, 0)], "fp string, status string, by string, us bigint, h int")
    state = reports.triage_state(df.drop("h"), "fp", "us", ("open", "fixed"))
    assert rows(state, "fp", "status", "by", "us") == {("a", "fixed", "me", 2), ("c", "open", "x", 5)}
    day = 86_400_000_000
    old = reports.clean_state(spark.createDataFrame([("a", "fixed", "m", 0), ("b", "fixed", "m", 1), ("c", "open", "m", 0)], "fp string, status string, by string, us bigint"), "us", F.timestamp_micros(F.lit(day)), 1, ("fixed",))
    assert rows(old, "fp") == {("b",), ("c",)}  # the limit itself is old
    merged = reports.merge_state(state, spark.createDataFrame([("a", "open", "you", 7)], "fp string, status string, by string, us bigint"), "fp")
    assert rows(merged, "fp", "by") == {("a", "you"), ("c", "x")}


def test_rule_errors(spark):
    df = spark.createDataFrame([("A", "high", 0.5, "x"), ("", "odd", 2.0, None), (None, None, None, "")], "rule_id string, severity string, confidence double, pattern string")
    assert [r.errors for r in reports.rule_errors(df).collect()] == [[], ["id", "severity", "confidence", "pattern"], ["id", "severity", "confidence", "pattern"]]


def test_security_metrics(spark):
    kind = "cost double, accepted int, rejected int, injection boolean, limited boolean, redactions array<struct<type:string,count:int>>"
    df = spark.createDataFrame([(1.0, 1, 2, True, None, [("a", 2), ("b", 1)]), (None, None, 1, None, True, None), (0.5, 0, 0, False, False, [])], kind)
    m = reports.security_metrics(df).first()
    assert (m.scans, m.injections, m.redacted, m.accepted, m.rejected, m.limited, m.cost, m.per_injection, m.rejection_rate, m.risk) == (3, 1, 3, 1, 3, 1, 1.5, 1.0, 0.75, "HIGH")
    assert rows(reports.redactions_by_type(df), "type", "count") == {("a", 2), ("b", 1)}
    empty = reports.security_metrics(df.limit(0)).first()
    assert (empty.scans, empty.redacted, empty.risk, empty.rejection_rate) == (0, 0, "LOW", 0.0)


def test_project_report_and_lines(spark):
    df = spark.createDataFrame([("p", "HIGH", f"t{k}", T, k, "x") for k in range(25)] + [("p", None, None, None, 99, "x"), (None, "critical", None, None, 1, "x")], "project string, severity string, title string, seen timestamp, id int, document string")
    got = {r.project: r.document for r in reports.project_report(df, "project", "severity", "title", "seen", "id").collect()}
    assert got["p"].startswith("| critical | 0 |\n| high | 25 |\n| medium | 0 |\n| low | 1 |\n- [high] t0\n") and got["p"].count("\n- ") == 20
    assert got[None].endswith("- [critical] ")
    u = spark.createDataFrame([("k", 1234, 5, 0, 1)], "key string, events bigint, prompt_tokens bigint, completion_tokens bigint, c int").withColumn("cost_usd", F.lit("0.12345").cast("decimal(20,8)"))
    assert u.select(reports.usage_line()).first()[0] == "| k | 1,234 | 5 | 0 | $0.1235 |"


def test_adapters_coverage_and_fall_through(spark):
    df = spark.createDataFrame([(1, "semgrep"), (1, None), (2, "odd")], "k int, engine string")
    assert rows(reports.skipped_adapters(df, "k", "engine", ("semgrep", "codeql"), ("semgrep",)), "k", "adapter", "reason") == {(1, "codeql", "unsupported-adapter"), (2, "semgrep", "no-result"), (2, "codeql", "unsupported-adapter")}
    assert rows(reports.technique_coverage(df, "k", "engine", ("semgrep", "x")), "k", "covered", "percent", "uncovered") == {(1, 1, 50.0, "x"), (2, 0, 0.0, "semgrep,x")}
    n = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 4), (2, 3)], "k int, line int")
    assert rows(reports.fall_through(n, "k", "line"), "k", "src", "dst") == {(1, 1, 2)}


# --- structure --------------------------------------------------------------------------------------------------------

def brute_dominators(nodes, edges, entry):
    def reach(without):
        seen, todo = set(), [entry] if entry != without else []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b for a, b in edges if a == x and b != without]
        return seen

    alive = reach(None)
    dom = {n: {d for d in alive if d == n or n not in reach(d)} for n in alive}
    return {n: next((d for d in dom[n] - {n} if dom[n] - {n} <= dom[d]), None) for n in alive}


@pytest.mark.parametrize("seed", range(6))
def test_dominators_as_by_removal(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 12)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(25))]
    assert structure.dominators(list(range(n)), edges, 0) == brute_dominators(range(n), edges, 0)


def test_flow_structure(spark):
    b = spark.createDataFrame([("f", k, "x") for k in (1, 3, 5, 7, 9)] + [("g", 1, "x")], "id string, start_line int, terminator string")
    e = spark.createDataFrame([("f", 1, 3), ("f", 3, 5), ("f", 5, 3), ("f", 3, 7)], "id string, src int, dst int")
    got = {(r.id, r.block): (r.idom, r.loop_depth, r.reachable) for r in structure.flow_structure(b, e, "id").collect()}
    assert got == {("f", 1): (None, 0, True), ("f", 3): (1, 1, True), ("f", 5): (3, 1, True), ("f", 7): (3, 0, True), ("f", 9): (None, 0, False), ("g", 1): (None, 0, True)}
    assert structure.flow_structure(b.limit(0), e.limit(0), "id").count() == 0


def test_calls_entries_and_reach(spark):
    text = "def a():\n    b(1)\n    print(2)\ndef b(x):\n    return x\nclass K: pass\ndef on_load():\n    a()\nb(3)"
    src = code.lines(spark.createDataFrame([("f", text), ("g", None)], "id string, t string"), "id", "t")
    assert rows(structure.call_edges(src, "id"), "caller", "callee", "n_calls") == {("a", "b", 1), ("on_load", "a", 1), ("on_load", "b", 1)}
    assert rows(structure.entry_points(src, "id"), "name", "line_no") == {("on_load", 7)}
    ev = code.flow_events(code.lines(spark.createDataFrame([("f", "x = 1\ny = x\nx = 2\nz = x + y")], "id string, t string"), "id", "t"), "id")
    last = spark.createDataFrame([("f", 4)], "id string, n_lines int")
    assert rows(structure.reaching_definitions(ev, last, "id"), "var", "def_line", "from_line", "to_line") == {("x", 1, 2, 3), ("x", 3, 4, 4), ("y", 2, 3, 4)}
    assert (4, 2, 2, 3) in rows(structure.used_lines(code.def_use_chains(ev, "id"), "id"), "line_no", "n_vars", "n_defined", "nearest")


def test_matches_that_span_lines(spark):
    df = spark.createDataFrame([(1, "a\nMath.random(\n)\nmd5(\nx)"), (2, None), (None, "md5(1)"), (3, "")], "k int, text string")
    assert rows(structure.text_matches(df, "k", "text"), "k", "type", "line_no") == {(1, "weakrand", 2), (1, "crypto", 4)}


def test_strong_connection(spark):
    e = lambda x: spark.createDataFrame(x, "src string, dst string")
    assert graph.strongly_connected(e([("a", "b"), ("b", "c"), ("c", "a")])).first()[0] is True
    assert graph.strongly_connected(e([("a", "b"), ("b", "c")])).first()[0] is False
    assert graph.strongly_connected(e([])).first()[0] is True


# --- scores -----------------------------------------------------------------------------------------------------------

def test_dimension_and_unified_scores(spark):
    n = spark.createDataFrame([("a", 1.0, None, 0.5, 40, 10, 1, True, "x"), ("b", None, None, None, None, None, None, None, "x")], "id string, pagerank double, betweenness double, avg_pagerank double, in_degree int, out_degree int, cyclomatic int, in_cycle boolean, score string")
    s = {(r.id, r.dim_id): r.score for r in scores.dimension_scores(n, ["id"]).collect()}
    assert (s["a", 3], s["a", 1], s["a", 10], s["a", 12]) == (0.7, 0.5, 0.1, 0.3) and s["b", 3] == 0.0 and len(s) == 46
    u = {r.id: (round(r.unified, 6), r.level, r.top_dim) for r in scores.unified_scores(scores.dimension_scores(n, ["id"]), ["id"]).collect()}
    total = sum(scores.DIMENSION_WEIGHTS.values())
    assert abs(total - 1.54) < 1e-9 and u["a"] == (round(0.7 / total, 6), "low", 3) and u["b"] == (round(0.5 * 0.15 / total / 0.2, 6), "low", 1)
    means = scores.with_project_values(spark.createDataFrame([("a", 1, 0.5, None), ("b", 1, None, None)], "id string, p int, pagerank double, betweenness double"), "p")
    assert rows(means, "id", "avg_pagerank", "avg_betweenness") == {("a", 0.5, None), ("b", 0.5, None)}


def test_factors_genes_and_encoders(spark):
    df = spark.createDataFrame([(0.5, True, 2, True, 0.5), (0.0, False, 0, False, 0.1), (1.0, True, 9, True, 1.0)], "t double, s boolean, l int, u boolean, o double")
    got = [round(r[0], 6) for r in df.select(scores.match_factor(*(F.col(c) for c in "tsluo"))).collect()]
    assert got == [2.0, 0.7, 2.0]
    g = spark.createDataFrame([("f", 1, 0.2, "a"), ("f", 2, 0.5, "a"), ("f", 3, 0.9, "b"), ("g", 4, 0.6, None)], "file string, id int, score double, kind string")
    assert rows(scores.apply_genes(g, ["file"], "score", "kind", "id", 0.3, {"a": 2.0}), "file", "id", "score") == {("f", 2, 1.0), ("g", 4, 0.6)}
    assert one(spark, "b", scores.one_hot(F.col("x"), ("a", "b"))) == [0.0, 1.0] and one(spark, None, scores.one_hot(F.col("x"), ("a", "b"))) == [0.0, 0.0]
    z = {r.k: round(r.z, 4) for r in scores.index_anomalies(spark.range(5).select(F.col("id").alias("k"), F.col("id").alias("place")), "k", 5).collect()}
    assert z[2] == 0.0 and z[0] == z[4] == round(2 / 2**0.5, 4)
    c = scores.weighted_composite({"a": F.col("x")}, {"a": 2.0}, {"a": 1.0})
    assert round(one(spark, None, c, "double"), 6) == round(1 / (1 + 2.718281828459045**-1), 6)
    assert round(spark.range(1).select(stats.forest_scores(F.lit(300))).first()[0], 9) == round(stats.forest_score(300), 9)


def brute_first_fit(truth, found, reach=5):
    used, out = set(), set()
    for i, line, kind in sorted(found):
        hit = next((j for j, at, name in sorted(truth) if j not in used and not (at and line and abs(at - line) > reach) and scores.same_type(kind, name)), None)
        out.add((i, hit))
        used.add(hit)
    return out | {(None, j) for j, _, _ in truth if j not in used}


@pytest.mark.parametrize("seed", [1, 2])
def test_first_fit_matches(spark, seed):
    rng = random.Random(seed)
    kinds = ["sqli", "sql_injection", "xss", "shell", "cmd", ""]
    make = lambda n: [(i, rng.choice([None, 0, 3, 8, 20]), rng.choice(kinds)) for i in range(n)]
    truth, found = make(12), make(15)
    t = spark.createDataFrame([("f", *x, 1) for x in truth] + [("only", 1, 1, "xss", 1), (None, 9, 1, "xss", 1)], "file string, id int, line int, type string, found_id int")
    f = spark.createDataFrame([("f", *x) for x in found], "file string, id int, line int, type string")
    m = scores.first_fit_matches(t, f, ["file"])
    zero = lambda xs: [(i, line or 0, k) for i, line, k in xs]
    assert rows(m.where("file = 'f'"), "found_id", "truth_id") == brute_first_fit(zero(truth), zero(found))
    assert rows(m.where("file = 'only'"), "found_id", "truth_id") == {(None, 1)}
    r = scores.match_rates(m, negatives=2).first()
    pairs = brute_first_fit(zero(truth), zero(found))
    assert r.tp == sum(a is not None and b is not None for a, b in pairs) and r.fp == 2 + sum(b is None for _, b in pairs)


def test_knowledge(spark):
    k = scores.knowledge_table(spark, [("k2", "C", "t", ""), ("k1", "C", "t", ""), ("k3", None, "t", ""), ("k4", "C", "u", ""), ("k5", "C", "u", "")])
    f = spark.createDataFrame([(1, "C", "u"), (2, None, "t"), (3, "X", None)], "id int, cwe string, kind string")
    k = k.withColumnRenamed("type", "kind")
    assert rows(scores.enriched(f, k.withColumnRenamed("kind", "type"), "id", "cwe", "kind").select("id", F.array_join("ids", ",").alias("ids")), "id", "ids") == {(1, "k1,k2,k4"), (2, "k1,k2,k3")}


# --- windows ----------------------------------------------------------------------------------------------------------

def test_rolling_sums_by_stretches(spark):
    rng = random.Random(3)
    hour = 3_600_000_000
    data = [("a", rng.randrange(0, 90) * hour, rng.randrange(9), "clash") for _ in range(80)] + [("b", -5 * hour, 4, "clash"), ("b", 0, None, "clash")]
    df = spark.createDataFrame(data, "k string, us bigint, v int, _x string")
    got = relational.rolling_sum(df, ["k"], "us", "v", 24, "s").collect()
    assert len(got) == len(data)
    for r in got:
        assert r.s == sum(v or 0 for k, us, v, _ in data if k == r.k and r.us - 24 * hour <= us <= r.us)
    t = relational.with_totals(df, {"total": "v"}).first()
    assert t.total == sum(v or 0 for *_, v, _ in data)


def test_same_type_is_symmetric():
    names = [s for group in scores.SYNONYMS for s in group]
    assert all(scores.same_type(a, b) == scores.same_type(b, a) for a, b in itertools.combinations(names, 2))
