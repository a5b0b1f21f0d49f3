"""Lookups that scan a table in its own order, against the scan."""

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import lookup as L


def scan(table, x, falling):
    """(pos, value) of the scan, None if there is none."""
    best = None
    for pos, (_, k, v) in enumerate(table, 1):
        if k is None or x is None:
            continue
        if k == x:
            return pos, v
        if (k < x) if falling else (k > x):
            break
        best = pos, v
    return best


@pytest.mark.parametrize("kind", ["random", "rising", "falling", "long first", "one", "blank", "empty"])
@pytest.mark.parametrize("array", [True, False])
def test_scans(spark, monkeypatch, kind, array):
    r = random.Random(kind)
    if not array:
        monkeypatch.setattr(L, "ARRAY_ROWS", 2)
    keys = {
        "random": [r.choice([None, float(r.randint(0, 40))]) for _ in range(200)], "rising": sorted(float(r.randint(0, 90)) for _ in range(150)),
        "falling": sorted((float(r.randint(0, 90)) for _ in range(150)), reverse=True), "long first": [5.0, 50.0, *[float(r.randint(0, 45)) for _ in range(150)], 60.0, 7.0],
        "one": [3.0], "blank": [None] * 5, "empty": [],
    }[kind]
    table = [(10 * i, k, f"v{i}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(table, "`row.at` long, k double, v string").repartition(7)
    asked = spark.createDataFrame([(i, None if i % 11 == 0 else float(i) / 2) for i in range(190)], "i int, `the.x` double")
    for falling in (False, True):
        found = L.vlookup_scan(asked, "the.x", df, "k", "v", "row.at", falling=falling)
        places = L.match_scan(asked, "the.x", df, "k", "row.at", -1 if falling else 1)
        want = {i: scan(table, x, falling) for i, x in asked.collect()}
        got = {q["i"]: (q["position"], q["position_error"]) for q in places.collect()}
        assert got == {i: (w[0], None) if w else (None, "#N/A") for i, w in want.items()}
        got = {q["i"]: (q["found"], q["found_error"]) for q in found.collect()}
        assert got == {i: (w[1], None) if w else (None, "#N/A") for i, w in want.items()}


def test_as_approximate_on_sorted_keys(spark):
    table = spark.createDataFrame([(k, float(k * k), f"v{k}") for k in range(60)], "o int, k double, v string")
    asked = spark.range(4000).select(F.col("id").cast("double").alias("x"))
    scanned = {r["x"]: r["found"] for r in L.vlookup_scan(asked, "x", table, "k", "v", "o").collect()}
    assert scanned == {r["x"]: r["found"] for r in L.lookup_approximate(asked, "x", table, "k", "v").collect()}


def test_columns_with_dots(spark):
    left = spark.createDataFrame([(1, 2.0, "p"), (2, 9.0, "q")], "`a.k` int, `x.y` double, lookup string")
    right = spark.createDataFrame([(1, "one", 1.0), (1, "two", 0.0)], "`b.k` int, `b.v` string, `b.o` double")
    got = L.vlookup_exact(left, "a.k", right, "b.k", "b.v", "b.o").collect()
    assert sorted((r["a.k"], r["found"], r["found_error"]) for r in got) == [(1, "two", None), (2, None, "#N/A")]
    assert sorted(r["found"] for r in L.lookup_approximate(left, "x.y", right, "b.k", "b.v").collect()) == ["one", "one"]
