"""Snapshot changes against a plain model, and the tables' parts."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from oreline.operators import snapshots

T = dt.datetime(2026, 1, 1)
RUNS = "id string, project_id string, status string, incremental_mode string, started_at timestamp, updated_at timestamp, findings_new int, findings_fixed int"
RAW = "scan_run_id string, rule_id string, file_path string, start_line int, severity string, h int, pair string"


def changes(spark, runs, raw, **kw):
    r = spark.createDataFrame(runs, RUNS)
    f = spark.createDataFrame([(*x, 0, "clash") for x in raw], RAW)
    return {tuple(x) for x in snapshots.snapshot_changes(f, r, **kw).select("scan_run_id", "rule_id", "file_path", "change_kind").collect()}


def run(i, n, project="p", status="done", mode="full", updated=0):
    return (i, project, status, mode, None if n is None else T + dt.timedelta(n), T + dt.timedelta(updated), 0, 0)


def wrong(monkeypatch):
    """Let every table yield one digest that no snapshot holds."""
    right = snapshots.changed_elements

    def bad(elements, max_rounds):
        found, failures = right(elements, max_rounds)
        first = F.row_number().over(Window.partitionBy(*snapshots.PLACE).orderBy("h", "sign")) == 1
        return found.withColumn("x", first).withColumn("d", F.when(F.col("x"), F.col("d") + 1).otherwise(F.col("d"))).drop("x"), failures

    monkeypatch.setattr(snapshots, "changed_elements", bad)


def test_hash_in_python_is_spark_s(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(50)]
    got = spark.createDataFrame(rows, "h bigint, d bigint").select("h", "d", F.xxhash64("h", "d", F.lit(103)).alias("x")).collect()
    assert all(snapshots.spark_xxhash64(r.h, r.d, 103) == r.x for r in got)


def test_kinds_of_change(spark):
    runs = [run("b", 2), run("a", 1), run("x", 3, status="failed"), run("c", 4), run("c", 4, status="queued", updated=-1), run("d", 5, mode="file"), run("e", None), run("z", 9, project="q")]
    raw = [("a", "R1", "./s\\f", 1, "high"), ("a", "r2", "f", 1, "low"), ("b", "r1", "s/f", 1, "WARNING"), ("b", "r1", "s/f", 1, "info"), ("b", "r3", "f", None, None), ("x", "r9", "f", 1, "low"), ("c", "r3", "f", 7, "low")]
    assert changes(spark, runs, raw) == {("b", "r2", "f", "removed"), ("b", "r3", "f", "added"), ("c", "r1", "s/f", "removed"), ("c", "r3", "f", "changed")}


def test_snapshots_without_findings_and_null_parts(spark):
    raw = [("a", None, "f", 1, "low"), ("a", "r", None, 1, "low"), ("c", "", "f", 1, "low")]
    got = changes(spark, [run("a", 1), run("b", 2), run("c", 3)], raw)
    assert got == {("b", None, "f", "removed"), ("b", "r", None, "removed"), ("c", "", "f", "added")}
    assert changes(spark, [], raw) == set() and changes(spark, [run("a", 1), run("b", 2)], []) == set()


@pytest.mark.parametrize("first_cells, rounds", [(36, 4), (6, 1), (6, 2), (36, 0)])
def test_as_a_plain_model_with_small_tables(spark, first_cells, rounds, monkeypatch):
    monkeypatch.setattr(snapshots, "STRETCH", 2)
    monkeypatch.setattr(snapshots, "BUCKET_RECORDS", 40)
    rng = random.Random(first_cells + rounds)
    runs = [run(f"s{n}", n) for n in range(6)]
    raw = [(f"s{n}", f"r{rng.randrange(30)}", f"f{rng.randrange(4)}", rng.randrange(2), rng.choice(["low", "high"])) for n in range(6) for _ in range(rng.choice([0, 80, 90]))]
    state: dict = {}
    for s, r, f, line, sev in raw:
        lo, hi, top = state.setdefault(s, {}).get((r, f), (9, -1, 0))
        state[s][r, f] = (min(lo, line), max(hi, line), max(top, {"low": 1, "high": 3}[sev]))
    want = set()
    for n in range(1, 6):
        a, b = state.get(f"s{n - 1}", {}), state.get(f"s{n}", {})
        want |= {(f"s{n}", *k, "added") for k in b.keys() - a.keys()} | {(f"s{n}", *k, "removed") for k in a.keys() - b.keys()} | {(f"s{n}", *k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert changes(spark, runs, raw, first_cells=first_cells, max_rounds=rounds) == want
    if first_cells == 6:
        wrong(monkeypatch)
        assert changes(spark, runs, raw) == want
