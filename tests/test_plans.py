"""Operators that SQL does not check, against plain models; and the entry module."""

from __future__ import annotations

import hashlib
import random

import __spark_entry__ as entry
from oreline.operators import code, findings, graph, logs, rules, stats


def test_every_sql_has_its_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and all(callable(f) for f in queries.values())


def test_chain_and_tampering(spark):
    rows = [("t", n, f"a{n}", None) for n in range(6)] + [("u", 1, "x", "y")]
    chain = logs.append_chain(spark.createDataFrame(rows, "tenant string, seq int, action string, meta string"), "tenant", "seq", ["action", "meta"]).cache()
    first = chain.where("tenant = 'u'").first()
    assert first.prev_hash == "0" and first.hash == hashlib.sha256(b"0|x|y").hexdigest()
    assert logs.broken_links(chain, "tenant", "seq", ["action", "meta"]).count() == 0
    bad = chain.selectExpr("tenant", "seq", "if(seq = 3, 'forged', action) as action", "meta", "prev_hash", "if(seq = 5, null, hash) as hash")
    assert {(r.tenant, r.seq) for r in logs.broken_links(bad, "tenant", "seq", ["action", "meta"]).collect()} == {("t", 3), ("t", 5)}


def test_limits_do_not_count_refused_calls(spark):
    df = spark.createDataFrame([("k", 1, 4.0), ("k", 2, 9.0), ("k", 3, 5.0), ("k", 4, 2.0), ("k", 5, None)], "k string, o int, x double")
    assert [r.accepted for r in logs.limited(df, "k", "o", "x", 10.0).orderBy("o").collect()] == [True, False, True, False, True]


def test_greedy_matches(spark):
    truth = spark.createDataFrame([("f", 1, 10), ("f", 2, 12), ("f", 3, 40), ("g", 4, 1)], "file string, id bigint, line int")
    found = spark.createDataFrame([("f", 1, 11), ("f", 2, 12), ("f", 3, 12), ("h", 4, 1)], "file string, id bigint, line int")
    got = {r.truth_id: (r.found_id, r.distance) for r in findings.greedy_matches(truth, found, ["file"]).collect() if r.truth_id is not None}
    assert got == {1: (1, 1), 2: (2, 0), 3: (None, None), 4: (None, None)}


def test_components_of_a_long_path(spark):
    edges = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)] + [("x", "x"), ("y", "z")]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {got[f"n{k:03d}"] for k in range(41)} == {"n000"} and got["x"] == "x" and got["z"] == "y"


def test_closure_with_a_cycle(spark):
    got = {(r.src, r.dst): r.hops for r in graph.closure(spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")).collect()}
    assert got == {("a", "b"): 1, ("a", "a"): 2, ("a", "c"): 2, ("b", "a"): 1, ("b", "b"): 2, ("b", "c"): 1}


def test_top_similar_over_several_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)] + [(500, None)]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(3)
    import numpy as np

    v = np.array([r[1] for r in rows[:90]], np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(v @ v.T, 6)
    want = {(q, j) for q in range(0, 90, 50) for j in sorted((j for j in range(90) if j != q and cos[q, j] >= 0.3), key=lambda j: (-cos[q, j], j))[:4]}
    got = {(r.query_id, r.id) for r in stats.top_similar(df.where("id % 50 = 0"), df, 4, 0.3).collect()}
    assert got == want


def test_weak_rules_of_every_type(spark):
    lines = {
        "r = java.util.Random().nextInt()": {"weakrand"}, 'KeyGenerator.getInstance("DES")': {"crypto"}, "new javax.crypto.spec.SecretKeySpec(k, 'AES', 'GCM')": {"crypto"}, 'MessageDigest.getInstance("MD2")': {"hash"}, "use md4 here": {"hash"},
        "crypt('md5', x)": {"crypto"}, "$_SESSION['last_session_id']++": {"weakrand"}, "echo 'hi ' . $_GET['x']": {"xss"}, "header('Location: ' . $_GET['u'])": {"ssrf"}, "shell_exec('ping ' . $_POST['h'])": {"shell"},
        "$GLOBALS['db']->query('SELECT ' . $x": {"sql"}, "echo 'hi'": set(),
    }
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "id int, text string")
    got = {(r.id, r.type) for r in code.typed_hits(code.lines(df, "id", "text"), "id", rules.WEAK_RULES).collect()}
    assert len(rules.WEAK_RULES) == 21 and got == {(k, t) for k, ts in enumerate(lines.values()) for t in ts}


def test_code_queries_read_samples_of_every_language(spark, tmp_path):
    text = "def f() {\n  x = 1\n  y = x\n  if (y) {\n    z = y\n  }\n}"
    rows = [(str(k), text, lang) for k, lang in enumerate(["python", "py", "JavaScript", "ts", "java", "c", "go", " ", None])] + [("none", None, "python")]
    spark.createDataFrame(rows, "id string, code string, language string").write.parquet(str(tmp_path / "training_samples.parquet"))
    names = "flow_d2_live flow_d3_chains flow_d4_dead flow_d4_unset flow_c1_blocks flow_c2_edges flow_c5_cyclomatic win_w5_overlap win_w9_nesting txt_t15_assignments txt_t16_scopes txt_t17_definitions"
    for name in names.split():
        found = {r.id for r in entry.queries()[name](spark, str(tmp_path)).select("id").collect()}
        assert found == {str(k) for k in range(9)}, name
