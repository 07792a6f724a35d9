"""Orphan references against a plain model."""

from __future__ import annotations

import datetime as dt
import random

from oreline.operators import orphans

T = dt.datetime(2026, 1, 1)


def day(n):
    return None if n is None else T + dt.timedelta(days=n)


def frames(spark, runs, findings, projects):
    r = spark.createDataFrame([(*x[:3], day(x[3]), 1, "clash") for x in runs], "id string, finding_id string, project_id string, created_at timestamp, rng int, key string")
    f = spark.createDataFrame([(i, day(c)) for i, c in findings], "id string, created_at timestamp")
    p = spark.createDataFrame([(i, day(c), day(e)) for i, c, e in projects], "id string, created_at timestamp, deleted_at timestamp")
    refs = orphans.references(r, {"finding_id": "findings", "project_id": "projects"})
    held = orphans.parents(f, "findings").unionByName(orphans.parents(p, "projects", to_col="deleted_at"))
    return refs, held


def found(refs, held, **kw):
    return {(r.ref_id, r.ref_field) for r in orphans.orphans(refs, held, **kw).collect()}


def test_spellings_times_and_deletion(spark):
    refs, held = frames(
        spark,
        [("1", " {AB} ", "p", 5), ("2", "ab", "p", 0), ("3", "", None, 5), ("4", "zz", "q", 5), ("5", "ab", "q", 2), ("6", "ab", "q", None), ("7", "{}", " ", 5)],
        [("AB", 1), (None, 0), ("x", None)], [("P", 0, None), ("q", 1, 3), ("q", 1, 3)],
    )
    assert found(refs, held) == {("2", "finding_id"), ("4", "finding_id"), ("4", "project_id"), ("6", "finding_id"), ("6", "project_id")}


def test_empty_sides(spark):
    refs, held = frames(spark, [("1", "a", None, 1)], [], [])
    assert found(refs, held) == {("1", "finding_id")}
    refs, held = frames(spark, [], [("a", 1)], [])
    assert found(refs, held) == set()


def test_hot_key_and_many_ranges_as_the_model(spark):
    rng = random.Random(3)
    findings = [(f"k{rng.randrange(60)}", rng.randrange(10)) for _ in range(80)]
    projects = [(f"p{rng.randrange(9)}", rng.randrange(6), rng.choice([None, 8, 3])) for _ in range(25)]
    runs = [(str(n), "k1" if n % 3 == 0 else f"k{rng.randrange(90)}", f"p{rng.randrange(11)}", rng.randrange(10)) for n in range(400)]
    runs += runs[:20]
    want = set()
    for i, f, p, at in runs:
        if not any(k == f and c <= at for k, c in findings):
            want.add((i, "finding_id"))
        if not any(k == p and c <= at and (e is None or e > at) for k, c, e in projects):
            want.add((i, "project_id"))
    refs, held = frames(spark, runs, findings, projects)
    assert found(refs, held, range_rows=7, batch_rows=20) == want
    missed = orphans.orphans(refs, held)
    report = {(r.ref_table, r.month): (r.n_refs, r.n_orphans) for r in orphans.orphan_report(refs, missed).collect()}
    assert report["findings", "2026-01"] == (400, sum(f == "finding_id" for _, f in want))
