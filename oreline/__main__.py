"""Command line: python -m oreline {scan,threat-model,rules,usage,version}."""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from pyspark.sql import functions as F

from oreline import pipeline
from oreline.functions.times import time_argument
from oreline.operators import reports
from oreline.session import build_session
from oreline.sources import files

VERSION = "0.2"


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="oreline")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("root")
    s.add_argument("--severity", default="low", choices=("low", "medium", "high", "critical"))
    s.add_argument("--confidence", type=float, default=0.3)
    s.add_argument("--format", default="json", choices=("json", "sarif"))
    s.add_argument("--state")
    sub.add_parser("threat-model").add_argument("root")
    r = sub.add_parser("rules")
    r.add_argument("--category")
    r.add_argument("--severity")
    u = sub.add_parser("usage")
    u.add_argument("log")
    u.add_argument("--since")
    u.add_argument("--until")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.command == "version":
        print(VERSION)
        return 0
    spark = spark or build_session("oreline", "local[*]")
    if a.command == "scan":
        found = pipeline.scan(spark, a.root, a.severity, a.confidence, state=files.read_state(spark, a.state) if a.state else None)
        report = pipeline.json_report(found) if a.format == "json" else files.sarif(found)
        print(report.first().document)
    elif a.command == "threat-model":
        _, _, risk = pipeline.threat_model(files.read_tree(spark, a.root))
        for row in risk.orderBy(F.desc("overall"), "path").toLocalIterator():
            print(row.path, row.overall, row.critical_paths)
    elif a.command == "rules":
        for row in pipeline.list_rules(spark, a.category, a.severity).orderBy("rule_id").toLocalIterator():
            print(row.rule_id, row.severity, row.confidence)
    else:
        now = dt.datetime.now(dt.UTC)
        iso = lambda t: t and t.isoformat()
        rows = files.read_usage(spark, a.log, since=iso(time_argument(a.since, now, False)), until=iso(time_argument(a.until, now)))
        g = rows.groupBy(F.coalesce("capability", F.lit("unknown")).alias("key")).agg(F.count(F.lit(1)).alias("events"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.coalesce(F.sum(F.col("cost_usd").cast("decimal(20,8)")), F.lit(0)).alias("cost_usd"))
        for row in g.orderBy(F.desc("cost_usd"), "key").select(reports.usage_line().alias("line")).toLocalIterator():
            print(row.line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
