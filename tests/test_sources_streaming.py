"""Sources, sinks and streaming forms."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from oreline.sources import files
from oreline.streaming import incremental


def test_tree_and_languages(spark, tmp_path):
    for p in ("src/a.py", "src/b.JS", "node_modules/c.js", "src/d.txt", "build/e.go"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    got = {(r.path.rsplit("/", 1)[-1], r.language) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert got == {("a.py", "python"), ("b.JS", "javascript")}


def test_usage_log_skips_what_does_not_parse(spark, tmp_path):
    lines = ['{"ts": "2026-01-01T00:00:00Z", "capability": "a"}', "", "{broken", '{"ts": "never", "capability": "b"}', '{"ts": "2026-01-03T00:00:00Z", "capability": "c"}']
    (tmp_path / "u.jsonl").write_text("\n".join(lines))
    rows = files.read_usage(spark, str(tmp_path / "u.jsonl"))
    assert {r.capability for r in rows.collect()} == {"a", "c"}
    assert {r.capability for r in files.read_usage(spark, str(tmp_path / "u.jsonl"), until="2026-01-01T00:00:00Z").collect()} == {"a"}


def test_tool_reports(spark):
    s = json.dumps({"results": [{"check_id": "r", "path": "a.py", "start": {"line": 3}, "extra": {"severity": "ERROR", "metadata": {"cwe": ["CWE-1"]}}}, {"check_id": "q"}, {"check_id": "z", "path": "b.py"}]})
    t = json.dumps({"Results": [{"Target": "lock", "Vulnerabilities": [{"VulnerabilityID": "V", "Severity": "HIGH"}]}, {"Target": "none"}]})
    df = spark.createDataFrame([(s,), ("not json",), (None,)], "report string")
    assert {(r.rule_id, r.line, r.cwe) for r in files.semgrep_findings(df).collect()} == {("r", 3, "CWE-1"), ("z", 1, None)}
    assert [(r.rule_id, r.file_path) for r in files.trivy_findings(spark.createDataFrame([(t,)], "report string")).collect()] == [("V", "lock")]


def test_truth_and_sarif(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# head\na,sqli,true,89\nb,xss,false,79\nc\n")
    assert [tuple(r) for r in files.read_truth(spark, str(tmp_path / "t.csv")).collect()] == [("a", "sqli", "89")]
    f = spark.createDataFrame([("r2", "T", "low", "m" * 600, "b", 1), ("r1", "T", "critical", "x", "a", 2)], "rule_id string, title string, severity string, message string, file_path string, line int")
    doc = json.loads(files.sarif(f).first()[0])
    run = doc["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["r1", "r2"]
    assert [(r["ruleId"], r["level"], len(r["message"]["text"])) for r in run["results"]] == [("r1", "error", 1), ("r2", "note", 503)]


def test_rescan_takes_the_latest_version_of_each_file(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"path": "a", "text": "md5 old", "version": 1}\n{"path": "a", "text": "md5 new", "version": 2}\n{"path": "b", "text": "ok", "version": 1}\n')
    q = incremental.rescan(incremental.changed_files(spark, str(src)), lambda df: df.where(F.col("text").contains("md5")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(60)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out" / "*" / "part")).collect()] == ["md5 new"]


def test_rolling_usage_counts_a_request_once(spark, tmp_path):
    rows = [(dt.datetime(2026, 1, 1, 10), "r1", "a", 5, 1.0), (dt.datetime(2026, 1, 1, 10), "r1", "a", 5, 1.0), (dt.datetime(2026, 1, 1, 11), "r2", "a", 7, 2.0)]
    schema = "at timestamp, request_id string, capability string, tokens int, cost_usd double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = incremental.rolling_usage(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "1 day", "1 day")
    q = stream.writeStream.outputMode("update").format("memory").queryName("rolled").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert [(r.calls, r.tokens, r.cost) for r in spark.table("rolled").collect()] == [(2, 12, 3.0)]
