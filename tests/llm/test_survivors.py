"""Representatives and surviving values of duplicate groups."""

from __future__ import annotations

import datetime as dt
import random

from oreline.llm import survivors

SCHEMA = "raw_id bigint, scan_run_id string, engine string, rule_id string, description string, severity string, confidence string, file_path string, start_line int, end_line int, code_snippet string, cwe_ids array<string>, reported_at timestamp, path string, at int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
T = dt.datetime(2026, 1, 1)
BLANK = {None, "", "n/a", "none", "unknown", "-"}


def row(i, **kw):
    base = dict(raw_id=i, scan_run_id="s", engine="e1", rule_id="R", description="d", severity="high", confidence="low", file_path="a/b", start_line=1, end_line=2, code_snippet="x", cwe_ids=["c"], reported_at=T, path="clash", at=3)
    return tuple((base | kw).values())


def run(spark, *rows):
    df = spark.createDataFrame(list(rows), SCHEMA)
    out = {r.group_id: r for r in survivors.survivors(df).collect()}
    assert {(r.group_id, r.best_id, r.n_rows) for r in out.values()} == {tuple(r) for r in survivors.representatives(df).collect()}
    return out


def test_order_of_preference(spark):
    got = run(spark, row(1, description="n/a"), row(2, reported_at=None), row(3, confidence=" HIGH"), row(4, confidence="high"), row(5, rule_id="r", file_path="./a//b\\", confidence="medium"))
    assert got[1].best_id == 3 and got[1].n_rows == 5


def test_single_rows_and_null_keys_form_no_group(spark):
    assert run(spark, row(1), row(2, start_line=2), row(3, start_line=None), row(4, start_line=None), row(5, rule_id=None), row(6, rule_id=None)) == {}
    assert run(spark) == {}


def test_nulls_everywhere(spark):
    blank = dict(engine=None, description=None, severity=None, confidence=None, end_line=None, code_snippet=None, cwe_ids=None, reported_at=None)
    got = run(spark, row(7, **blank), row(8, **blank), row(None, **blank))
    assert (got[7].best_id, got[7].n_rows, got[7].severity) == (7, 2, None)


def test_precedence_is_a_strict_partial_order():
    order = survivors.precedence([("s", "low", "high", 3), ("s", "high", "low", 1), ("s", "high", "fatal", 2), ("c", "a", "b", 1), ("c", "b", "c", 1), ("c", "c", "a", 1), ("c", "c", "z", 1)])
    assert order["s", "low"] == {"high", "fatal"} and order["s", "high"] == {"fatal"}
    assert order["c", "a"] == order["c", "b"] == order["c", "c"] == {"z"}  # the circle itself is not compared


def test_undated_values_take_their_topological_place(spark):
    learn = [row(10 + 2 * k + j, start_line=100 + k, severity=s, reported_at=T + dt.timedelta(hours=j)) for k in range(3) for j, s in enumerate(("low", "critical"))]
    got = run(spark, *learn, row(1, severity="low"), row(2, severity="critical", reported_at=None))
    assert got[1].severity == "critical"  # undated, but learned to come after the dated value
    got = run(spark, *learn, row(1, severity="critical"), row(2, severity="low", reported_at=None))
    assert got[1].severity == "critical"
    got = run(spark, *learn, row(1, severity="odd"), row(2, severity="low", reported_at=None), row(3, severity="critical", reported_at=None))
    assert got[1].severity == "odd"  # never seen beside the others: not compared, so the dated value stands
    got = run(spark, *learn, row(1, severity="low", reported_at=None), row(2, severity="odd", reported_at=None, end_line=None))
    assert got[1].severity == "low"  # both are latest; the fuller row decides


def test_a_field_of_many_values_is_no_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(survivors, "MAX_VALUES", 3)
    got = run(spark, *(row(k, engine=f"e{k}", reported_at=T + dt.timedelta(hours=k % 7)) for k in range(20)))
    assert (got[0].engine, got[0].n_rows, got[0].severity) == ("e13", 20, "high")  # of the latest values the longer one


def chain(n):
    """Groups that teach ``n`` engines to follow each other one by one."""
    return [row(1000 + 2 * k + j, start_line=1000 + k, engine=f"x{k + j:03}", reported_at=T + dt.timedelta(hours=j)) for k in range(n - 1) for j in (0, 1)]


def test_any_number_of_values_is_learned(spark):
    ask = (row(1, engine="x000"), row(2, engine="x150", reported_at=None), row(3, engine="x120", reported_at=None))
    for n in (151, 200, 201, 400):  # the group's result is the same beside other groups of few and of many values
        got = run(spark, *chain(n), *ask)
        assert (got[1].engine, got[1].n_rows) == ("x150", 3)


def test_steps_answer_as_the_whole_precedence():
    rng = random.Random(7)
    for n in (3, 8, 8, 30, 30, 60):
        pairs = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice((n, 2 * n)))) if a != b}
        pairs -= {(b, a) for a, b in pairs if a < b}
        whole = survivors.precedence(("s", str(a), str(b), 1) for a, b in pairs)
        order = survivors.Order(("s", str(a), str(b)) for a, b in pairs)
        for _ in range(100):
            values = [str(rng.randrange(n + 2)) for _ in range(rng.randrange(1, 7))]
            assert order.latest("s", values) == next(i for i, v in enumerate(values) if not whole.get(("s", v), set()) & set(values))
    long = survivors.Order(("s", str(k), str(k + 1)) for k in range(100_000))
    assert long.latest("s", ["0", "odd", "100000"]) == 1 and long.latest("s", ["0", "99999", "100000"]) == 2


def plain(data):
    """The same in plain Python: groups, learned precedence, latest values."""
    groups: dict = {}
    for r in (dict(zip(NAMES, x)) for x in data):
        groups.setdefault(r["start_line"], []).append(r)
    val = lambda r, c: None if r[c] is None or r[c].lower().strip() in BLANK else r[c].lower().strip()
    n = lambda r: sum(val(r, c) is not None for c in ("description", "severity", "confidence", "code_snippet")) + 2
    conf = lambda r: {"high": 3, "medium": 2, "low": 1}.get((r["confidence"] or "").lower(), 0)
    key = lambda r: (-n(r), r["reported_at"] is None, -(r["reported_at"] or T).timestamp(), -conf(r), r["raw_id"])
    counts: dict = {}
    for g in groups.values():
        for c in survivors.CURRENCY_FIELDS:
            first: dict = {}
            for r in g if len(g) > 1 else ():
                if r["reported_at"] and val(r, c):
                    first[val(r, c)] = min(first.get(val(r, c), r["reported_at"]), r["reported_at"])
            seq = sorted((t, v) for v, t in first.items())
            for (t, a), (u, b) in zip(seq, seq[1:]):
                if u > t:
                    counts[c, a, b] = counts.get((c, a, b), 0) + 1
    order = survivors.precedence((*k, v) for k, v in counts.items())
    out = {}
    for g in groups.values():
        if len(g) < 2:
            continue
        values = []
        for c in survivors.CURRENCY_FIELDS:
            dated = max(((r["reported_at"], val(r, c)) for r in g if r["reported_at"] and val(r, c)), default=None)
            cand = [(1, 0, 0, 0, dated[1])] if dated else []
            for v in {val(r, c) for r in g if not r["reported_at"] and val(r, c)}:
                # the best row of a combination of values stands for the value; the best over combinations is the same
                cand.append((0, *max((n(r), conf(r), -r["raw_id"]) for r in g if not r["reported_at"] and val(r, c) == v), v))
            every = {x[-1] for x in cand}
            values.append(max((x for x in cand if not order.get((c, x[-1]), set()) & every), default=(None,))[-1])
        out[min(x["raw_id"] for x in g)] = (min(g, key=key)["raw_id"], *values)
    return out


def test_as_a_plain_model_on_random_rows(spark):
    for seed in (4, 5):
        rng = random.Random(seed)
        times = [None, None, T, T + dt.timedelta(1), T + dt.timedelta(2)]
        data = [row(i, start_line=rng.randrange(60), engine=rng.choice(["a", "b", "c"]), severity=rng.choice(["x", "y", "z", None]), confidence=rng.choice(["high", "HIGH", "low", None, "n/a"]), description=rng.choice(["d", "", "-"]), reported_at=rng.choice(times)) for i in range(200)]
        got = {k: (v.best_id, v.engine, v.confidence, v.severity) for k, v in run(spark, *data).items()}
        assert got == plain(data)
