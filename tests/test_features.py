"""Per-entity feature table."""

from __future__ import annotations

import datetime as dt

import pytest

from oreline.operators import features

SCHEMA = "ts string, capability string, cost_usd double, scan_id string, request_id string, received_at timestamp, prompt_tokens int, completion_tokens int, entity string, at string, n_events int"
T = dt.datetime(2026, 1, 1)


def events(spark, *rows):
    base = ("2026-01-01T10:00:00Z", "a", 1.0, "s", "r", T, 1, 2, "clash", "clash", 9)
    return spark.createDataFrame([tuple(r.get(n, b) for n, b in zip(("ts", "capability", "cost_usd", "scan_id", "request_id", "received_at", "prompt_tokens", "completion_tokens"), base)) + base[8:] for r in rows], SCHEMA)


def long(spark, *rows):
    return {(r.entity, r.event_type): r for r in features.features_long(events(spark, *rows)).collect()}


def test_deliveries_of_one_request_are_one_event(spark):
    got = long(spark, {"request_id": "r1", "cost_usd": 1.0}, {"request_id": "r1", "cost_usd": 7.0, "received_at": T + dt.timedelta(1)}, {"request_id": "r1", "cost_usd": None, "received_at": T + dt.timedelta(9)}, {"request_id": "r2"})
    assert got["s", "a"].n_events == 2
    assert got["s", "a"].cost == 8.0


@pytest.mark.parametrize("ts", [None, "", "NaN", "invalid date", "2026-02-30T10:00:00Z", "2026-01-01", "2026-13-01T00:00:00Z"])
def test_unusable_times(spark, ts):
    assert not long(spark, {"ts": ts})


@pytest.mark.parametrize("ts", ["2026-01-01T10:00:00Z", "2026-01-01T18:00:00.000+08:00", " 2026-01-01 10:00:00+00:00 "])
def test_spellings_of_an_instant(spark, ts):
    got = long(spark, {"ts": ts})["s", "a"]
    assert got.last_at == dt.datetime(2026, 1, 1, 10)


def test_names_are_trimmed_and_blank_ones_dropped(spark):
    got = long(spark, {"capability": " A\t"}, {"capability": "a", "request_id": "q"}, {"capability": " "}, {"capability": None}, {"scan_id": None}, {"scan_id": "  "})
    assert set(got) == {("s", "a")} and got["s", "a"].n_events == 2


def test_rows_without_request_count_no_event(spark):
    got = long(spark, {"request_id": None, "cost_usd": 5.0}, {"request_id": "x"})["s", "a"]
    assert (got.n_events, got.cost) == (1, 1.0)


def test_wide_form_keeps_types_outside_the_list(spark):
    e = events(spark, {"capability": "a"}, {"capability": "b", "request_id": "y", "ts": "2026-01-02T10:00:00Z"}, {"capability": "c", "request_id": "z", "scan_id": "t"})
    rows = {r.scan_id: r for r in features.features_wide(features.features_long(e), ["a"], "2026-01-02T10:00:00Z").collect()}
    s = rows["s"]
    assert (s.n_a, s.n_other, s.n_all, s.age_a, s.age_other) == (1, 1, 2, 86400.0, 0.0)
    assert (rows["t"].n_a, rows["t"].age_a, rows["t"].n_other) == (0, None, 1)


def test_clashing_column_names_and_empty(spark):
    e = events(spark, {"capability": "a.b"}, {"capability": "a_b", "request_id": "y"})
    cols = features.features_wide(features.features_long(e)).columns
    assert len(cols) == len(set(cols))
    assert features.features_wide(features.features_long(e.limit(0))).count() == 0
