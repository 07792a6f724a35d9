"""Scans from end to end, and the remaining readers and writers."""

from __future__ import annotations

import hashlib
import json

from oreline import pipeline
from oreline.sources import files


def tree(tmp_path):
    for name, text in {"a.py": "x = md5(y)\n# md5 in a comment\nz = 1\nxor_this (q)", "b/c.js": "Math.random()", "node_modules/d.js": "md5"}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return str(tmp_path)


def test_scan_with_baseline_and_state(spark, tmp_path):
    root = tree(tmp_path)
    found = pipeline.scan(spark, root)
    got = {(r.file_path.rsplit("/", 1)[-1], r.line, r.rule_id) for r in found.collect()}
    assert ("a.py", 1, "CRYPTO-001") in got and ("a.py", 4, "CRYPTO") in got and ("c.js", 1, "CRYPTO-002") in got and not any(x[1] == 2 or x[0] == "d.js" for x in got)
    fps = [r.fp for r in found.collect()]
    base = spark.createDataFrame([(fps[0],), (fps[0],)], "fp string")
    state = spark.createDataFrame([(fps[1], "fixed"), (fps[2], "confirmed")], "fp string, status string")
    left = {r.fp: r.status for r in pipeline.scan(spark, root, baseline=base, state=state).collect()}
    assert set(left) == set(fps) - set(fps[:2]) and left[fps[2]] == "confirmed"
    assert pipeline.scan(spark, root, least_severity="critical", least_confidence=0.99).count() == 0
    assert {r.project for r in pipeline.scan_project(spark, [root]).collect()} == {root}


def test_reports_and_look_ups(spark, tmp_path):
    doc = json.loads(pipeline.json_report(pipeline.scan(spark, tree(tmp_path))).first().document)
    assert doc["summary"]["high"] >= 1 and doc["findings"] == sorted(doc["findings"], key=lambda f: (f["file_path"], f["line"], f["rule_id"]))
    assert pipeline.scan_code(spark, "md5(x)").count() >= 1 and pipeline.scan_code(spark, "").count() == 0
    assert {r.rule_id for r in pipeline.list_rules(spark, "RACE", "high").collect()} == {"RACE-001"}
    assert {r.type for r in pipeline.lookup_cwe(spark, "CWE-643").collect()} == {"xpath", "xpathi"}


def test_threat_model(spark):
    texts = spark.createDataFrame([("a", "q = req.query.id\nos.system(q)"), ("b", None)], "path string, text string")
    boundaries, threats, risk = pipeline.threat_model(texts)
    assert [(r.path, r.type) for r in boundaries.collect()] == [("a", "process")]
    assert {r.category for r in threats.collect()} == {"tampering", "elevation_of_privilege"} and risk.first().overall == 28
    assert [tuple(r) for r in pipeline.attack_surface(texts).collect()] == [("a", 1, 1, 45)]


def test_truth_state_and_status(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"web": {"positives": [{"file": "a", "type": "xss", "line": 3}], "negatives": [{"file": "b", "type": "sql"}]}, "none": {}}))
    assert {tuple(r) for r in files.read_truth_json(spark, str(tmp_path / "t.json")).collect()} == {("web", "a", "xss", 3, True), ("web", "b", "sql", None, False)}
    (tmp_path / "s.json").write_text(json.dumps({"version": 1, "fingerprints": {"f": {"status": "fixed", "by": "me", "at": "t"}, "g": {"status": "odd"}, "h": {"status": "open"}}}))
    assert {tuple(r) for r in files.read_state(spark, str(tmp_path / "s.json")).collect()} == {("f", "fixed", "me", "t"), ("h", "open", "unknown", "")}
    (tmp_path / "bad.json").write_text("{no json")
    assert files.read_state(spark, str(tmp_path / "bad.json")).count() == 0
    one = json.dumps({"findings": [{"rule_id": "r"}]})
    df = spark.createDataFrame([("a", one, 0, False), ("b", one, 1, False), ("c", "junk", 1, None), ("d", None, None, True), ("e", None, None, None)], "engine string, report string, exit_code int, timed_out boolean")
    assert {(r.engine, r.status, r.n_findings) for r in files.engine_status(df).collect()} == {("a", "success", 1), ("b", "partial", 1), ("c", "failed", 0), ("d", "timeout", 0), ("e", "success", 0)}


def test_logs_are_appended_and_exported(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01T00:00:00Z", 'say "hi", you'), ("2026-01-02T00:00:00Z", None)], "ts string, capability string")
    files.append_usage(df, str(tmp_path / "log"))
    files.append_usage(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    manifest = files.export_audit(df.coalesce(1), str(tmp_path / "csv")).collect()
    assert [(m.file, m.digest) for m in manifest] == [(p.name, hashlib.sha256(p.read_bytes()).hexdigest()) for p in (tmp_path / "csv").glob("*.csv")]
    assert '"say ""hi"", you"' in (tmp_path / "csv" / manifest[0].file).read_text()
    doc = json.loads(files.export_json(df, "now").first().document)
    assert (doc["exported_at"], doc["total"], len(doc["events"])) == ("now", 2, 2)


def test_large_files_keep_their_row(spark, tmp_path):
    (tmp_path / "a.py").write_text("x" * 50)
    (tmp_path / "b.py").write_text("y")
    t = files.read_tree(spark, str(tmp_path), max_bytes=10)
    assert {(r.path.rsplit("/", 1)[-1], r.text) for r in t.collect()} == {("a.py", None), ("b.py", "y")}
    assert [tuple(r) for r in files.too_large(t).collect()] == [("python", 1, 50)]
