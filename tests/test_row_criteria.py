"""Criteria from rows against the same criteria as constants, one row after the other."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import criteria as C
from quillgrid.operators import row_criteria as R
from quillgrid.operators.row_criteria import By


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(1)
    words = ["north", "North", "south", "10", " 10", "7.5", "", None, "zeta", "Ärger", "a|b"]
    rows = [(k, r.choice(words), r.choice([None, float(r.randint(-9, 9)), r.random() * 9, -0.0]), r.choice([None, r.randint(0, 12)]), date(2024, 1, 1) + timedelta(r.randint(0, 40)), r.choice([True, False, None]), r.choice([None, 1.5, 2.25, -3.0])) for k in range(400)]
    table = spark.createDataFrame(rows, "id int, `area.name` string, price double, size int, day date, open boolean, worth double")
    asks = [(k, r.choice([*words, "nowhere"]), r.choice([None, float(r.randint(-10, 10)), r.random() * 9, 0.0]), r.choice([None, r.randint(-1, 13)]), date(2024, 1, 1) + timedelta(r.randint(-2, 42)), r.choice([True, None]), r.choice([">=3", "<>north", "<=m", ">7", "<7.5", "=", "<>", "north", "10", "5", None, "=zeta", ">=north", "<"])) for k in range(45)]
    return table, spark.createDataFrame(asks, "k int, area string, price double, size int, day date, open boolean, `any` string")


def constant(table, pairs):
    """The count, sum and mean by criterion(): a constant criterion for each pair."""
    met = C.criteria(table.withColumnRenamed("area.name", "area"), *pairs) if pairs else F.lit(True)
    return [F.count_if(met), F.coalesce(F.sum(F.when(met, F.col("worth"))), F.lit(0.0)), F.avg(F.when(met, F.col("worth")))]


def text_of(op, v):
    return op + ("" if v is None else str(v))


CASES = [
    [("size", "=", "size")],
    [("area.name", "=", "area"), ("size", "<=", "size")],
    [("area.name", "<>", "area"), ("price", ">", "price")],
    [("price", "<", "price")],
    [("price", ">=", "price"), ("price", "<=", "size")],
    [("area.name", "<=", "area")],
    [("area.name", ">", "area"), ("size", "<>", "size")],
    [("price", "<=", "price"), ("size", ">", "size")],
    [("area.name", "=", "area"), ("price", ">", "price"), ("size", "<", "size")],
    [("price", ">=", "price"), ("size", ">=", "size"), ("size", "<=", "price")],
    [("area.name", "", "any")],
    [("size", "", "size"), ("area.name", "", "area")],
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_as_constants(tables, case):
    table, rows = tables
    by = [By(*c) for c in CASES[case]]
    got = {r["k"]: r for r in R._measured(rows, table, tuple(by), "worth").collect()}
    plain = table.withColumnRenamed("area.name", "area")
    asked, exprs = rows.collect(), []
    for r in asked:
        pairs = [x for c, op, cell in CASES[case] for x in (c.split(".")[0], text_of(op, r[cell]) if op else r[cell])]
        exprs += [e.alias(f"e{len(exprs) + i}") for i, e in enumerate(constant(plain, pairs))]
    want = []
    for at in range(0, len(exprs), 90):
        want += plain.agg(*exprs[at : at + 90]).first()
    assert len(got) == len(asked)
    for i, r in enumerate(asked):
        n, total, mean = want[3 * i : 3 * i + 3]
        mine = got[r["k"]]
        assert mine["criteria rows"] == n and abs(mine["criteria total"] - total) < 1e-9, r
        assert (mine["criteria numbers"] == 0) == (mean is None) and (mean is None or abs(mine["criteria total"] / mine["criteria numbers"] - mean) < 1e-9)


def test_dates_booleans_and_kinds(tables):
    table, rows = tables
    got = {r["k"]: r["count"] for r in R.COUNTIFS(rows, table, By("day", ">=", "day"), By("open", "=", "open")).collect()}
    cells = [(r["day"], r["open"]) for r in table.collect()]
    assert got == {r["k"]: sum(d >= r["day"] and o == r["open"] for d, o in cells) for r in rows.collect()}
    for wrong in ([By("day", "<", "size")], [By("price", "<", "price"), By("price", "<=", "size")], [By("price", "<", "price"), By("size", "<", "size"), By("id", "<", "k")], [By("area.name", "<", "area"), By("size", "<", "size")]):
        with pytest.raises(ValueError):
            R.COUNTIFS(rows, table, *wrong)
    assert R.COUNTIFS(rows.where("false"), table, By("size", "<", "size")).count() == 0
    assert {r["count"] for r in R.COUNTIFS(rows, table.where("false"), By("size", "<", "size")).collect()} == {0}
    meant = R.AVERAGEIFS(rows, table, "worth", By("size", "=", "size")).collect()
    worth = [(r["size"], r["worth"]) for r in table.where("worth IS NOT NULL").collect()]
    for r in meant:
        own = [w for z, w in worth if z == r["size"]]
        assert (r["average"], r["average_error"]) == (pytest.approx(sum(own) / len(own)) if own else None, None if own else "#DIV/0!")
    assert {r["sum"] for r in R.SUMIFS(rows, table, "area.name", By("size", ">=", "size")).collect()} == {0.0}


def test_one_key_over_many_partitions(spark):
    """No equal criterion: one running total, and dominance over all partitions; equal values and rows repeat."""
    r = random.Random(2)
    points = [(float(r.randint(0, 300)), float(r.choice([1, 1, 1, r.randint(0, 300)])), 1.0) for _ in range(5000)]
    table = spark.createDataFrame(points, "x double, y double, w double")
    rows = spark.createDataFrame([(k, float(r.randint(-5, 305)), float(r.randint(-5, 305))) for k in range(300)] * 2, "k int, a double, b double")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        one = R.COUNTIFS(rows, table, By("x", "<", "a")).collect()
        two = R.SUMIFS(rows, table, "w", By("x", "<=", "a"), By("y", ">", "b")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(one) == len(two) == 600
    assert all(q["count"] == sum(x < q["a"] for x, _, _ in points) for q in one)
    assert all(q["sum"] == sum(x <= q["a"] and y > q["b"] for x, y, _ in points) for q in two)
    plan = R.COUNTIFS(rows, table, By("x", "<=", "a"), By("y", ">", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
