"""The command line, time arguments and the line locator."""

from __future__ import annotations

import datetime as dt
import json

from oreline.__main__ import main
from oreline.functions.times import duration_seconds, time_argument
from oreline.operators import locator

NOW = dt.datetime(2026, 3, 1, 12, tzinfo=dt.UTC)


def test_time_arguments():
    assert [duration_seconds(x) for x in ("5s", "2m", "1h", "1d", "2w", "x", "5")] == [5, 120, 3600, 86400, 1209600, None, None]
    assert time_argument("2d", NOW) == NOW - dt.timedelta(2) and time_argument("now", NOW) == NOW
    assert time_argument("2026-01-02", NOW) == dt.datetime(2026, 1, 2, 23, 59, 59, 999000, tzinfo=dt.UTC) and time_argument("2026-01-02", NOW, end=False) == dt.datetime(2026, 1, 2, tzinfo=dt.UTC)
    assert time_argument("2026-01-02T03:00:00+02:00", NOW) == dt.datetime(2026, 1, 2, 1, tzinfo=dt.UTC) and time_argument("never", NOW) is None and time_argument(None, NOW) is None


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.py").write_text("x = md5(y)\nq = req.query.id\nos.system(q)\n")
    assert main(["version"]) == 0 and main(["scan", str(tmp_path), "--severity", "high"], spark) == 0
    lines = capsys.readouterr().out.splitlines()
    assert json.loads(lines[1])["summary"]["high"] >= 1
    assert main(["scan", str(tmp_path), "--format", "sarif"], spark) == 0 and json.loads(capsys.readouterr().out)["version"] == "2.1.0"
    assert main(["threat-model", str(tmp_path)], spark) == 0
    assert capsys.readouterr().out.strip().endswith(" 28 2")  # 90 and 85, each times .85, of 540; both critical
    assert main(["rules", "--category", "RACE"], spark) == 0 and capsys.readouterr().out.startswith("RACE-001 high")
    (tmp_path / "u.jsonl").write_text('{"ts": "2026-01-01T00:00:00Z", "capability": "a", "prompt_tokens": 1200, "cost_usd": 0.5}\n{"ts": "2026-02-01T00:00:00Z"}\n')
    assert main(["usage", str(tmp_path / "u.jsonl"), "--until", "2026-01-01"], spark) == 0
    assert capsys.readouterr().out == "| a | 1 | 1,200 | 0 | $0.5000 |\n"


def test_locator(spark):
    rows = [
        (1, "INJ-001", None, None, 0.5, "a\nb\nc\nd\nx == query(sql)\ne\nf\ng\nh"), (2, "", "Odd", ["CWE-89"], 0.5, "a\nb\nrun_sql\nexec (x)"), (3, "", None, None, 0.4, "a"), (4, "", "SQL", None, 0.5, None),
        (5, "", "buffer", [None], 0.9, "strcpy(user)\nstrcpy(user)"), (6, "", None, None, 0.4, ""),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id int, rule string, name string, cwes array<string>, confidence double, text string, n string")
    got = {r.id: (r.start_line, r.end_line, round(r.confidence, 6), r.how) for r in locator.locate(df, "id").collect()}
    assert got == {1: (2, 8, 1.0, "scored"), 2: (4, 4, 0.35, "sink"), 3: (1, 1, 0.2, "whole"), 5: (1, 2, 1.0, "scored"), 6: (1, 1, 0.2, "whole")}
