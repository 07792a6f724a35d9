"""The relational helpers, as-of joins and the plug-in registry."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from oreline.functions import text
from oreline.operators import relational as R
from oreline.operators import vectors
from oreline.operators.registry import Registry

A, B = "a" * 36, "b" * 36


def test_row_security(spark):
    df = spark.createDataFrame([(1, A, B), (2, A, A), (3, B, B)], "id int, tenant_id string, customer_id string")
    ids = lambda **kw: sorted(r.id for r in R.secured(df, **kw).collect())
    assert ids(tenant=A, role="ProviderViewer") == [1, 2] and ids(tenant=A, customer=B, role="Customer") == [1]
    assert ids(tenant=A) == [] == ids(tenant="short", role="ProviderOwner") == ids(tenant=None)
    assert ids(tenant=None, role="SystemBot") == [1, 2, 3]


def test_filters(spark):
    df = spark.createDataFrame([(1, "50% off", None), (2, "500 off", "X_y"), (3, None, "xzy")], "id int, a string, b string")
    assert [r.id for r in R.contains_text(df, ["a", "b"], "0% O").collect()] == [1]
    assert [r.id for r in R.contains_text(df, ["a", "b"], "x_Y").collect()] == [2]
    assert [r.id for r in R.where_all(df, {"a": None, "id": [2, 3]}).orderBy("id").collect()] == [2, 3]


def test_latest_upsert_and_pages(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 9, "z"), ("b", None, "w")], "id string, updated_at int, v string")
    assert {tuple(r) for r in R.latest_rows(df).collect()} == {("a", 2, "y"), ("b", None, "w")}
    new = spark.createDataFrame([("a", 5, "n"), ("c", 1, "m")], df.schema)
    old = R.latest_rows(df)
    assert {r.id: r.v for r in R.upsert(old, new, ["id"]).collect()} == {"a": "n", "b": "w", "c": "m"}
    assert {r.id: r.v for r in R.upsert(old, new, ["id"], update=False).collect()} == {"a": "y", "b": "w", "c": "m"}
    assert [r.id for r in R.page(spark.range(9), [F.col("id").desc()], 2, 3).collect()] == [6, 5, 4]


def test_as_of_takes_the_row_before(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("m", 3)], "k string, t int")
    right = spark.createDataFrame([("k", 1, "a"), ("k", 4, "b"), ("k", 4, "c"), ("k", 5, "d")], "k string, t int, v string")
    assert {(r.k, r.t): r.v_as_of for r in vectors.as_of(left, right, ["k"], "t", ["v"]).collect()} == {("k", 5): "c", ("k", 1): None, ("m", 3): None}


def test_text_expressions(spark):
    df = spark.createDataFrame([(r".\a//b\.\c", " {AB} ", "Warning"), ("", "{ }", None), (None, None, "odd")], "p string, k string, s string")
    got = df.select(text.clean_path("p"), text.plain_key("k"), text.service_severity("s"), text.filled("k")).collect()
    assert [tuple(r) for r in got] == [("a/b/c", "ab", "high", True), ("", None, "low", True), (None, None, "low", False)]


def test_registry(spark):
    reg = Registry()
    reg.load("one", "probe", lambda df: df.select("id", F.lit(0.9).alias("confidence")), ["fast"])
    reg.load("bad", "probe", lambda df: df.select("nothing"))
    reg.load("two", "probe", lambda df: df.select("id", F.lit(0.1).alias("confidence")))
    found, errors = reg.run(spark.range(2))
    assert found.count() == 2 and set(errors) == {"bad"}
    assert [p.name for p in reg.select("probe", "fast")] == ["one"]
    with pytest.raises(ValueError):
        reg.load("one", "probe", lambda df: df)
    reg.unload("one")
    reg.unload("none")
    assert [p.name for p in reg.select()] == ["bad", "two"]
