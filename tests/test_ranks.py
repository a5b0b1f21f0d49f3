"""Ranks within groups against sorted lists, by bracket search and by range partitions."""

import random
from statistics import median

import pytest

from quillgrid.operators import filters as FL
from quillgrid.operators import ranks as RK


@pytest.fixture(scope="module")
def grouped(spark):
    r = random.Random(7)
    rows = [("hot", 1, float(k)) for k in r.sample(range(10**6), 6000)]  # one group of distinct values holds most rows
    rows += [("ties", k % 2, 5.0) for k in range(900)] + [("ties", 0, float(k)) for k in range(7)]
    rows += [(None, None, float(k)) for k in range(10)] + [("one", 3, -2.5), ("none", 4, None), ("nan", 5, float("nan")), ("nan", 5, 1.0), ("few", 6, 1.0), ("few", 6, 2.0)]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "`the.group` string, part int, v double")


def sorted_groups(rows):
    out = {}
    for g, p, v in rows:
        own = out.setdefault((g, p), [])
        if v is not None and v == v:
            own.append(v)
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("way", ["one round", "several rounds", "range partitions"])
def test_ranks(grouped, monkeypatch, way):
    rows, df = grouped
    if way == "several rounds":
        monkeypatch.setattr(RK, "FEW", 20)
        monkeypatch.setattr(RK, "CUTS", 4)
    if way == "range partitions":
        monkeypatch.setattr(RK, "MOST_GROUPS", 3)
    want = sorted_groups(rows)
    by = ["the.group", "part"]
    got = {(r["the.group"], r["part"]): (r["median"], r["error"]) for r in RK.MEDIANS(df, "v", by).collect()}
    assert got == {k: (median(v), None) if v else (None, "#NUM!") for k, v in want.items()}
    got = {(r["the.group"], r["part"]): tuple(r)[2:] for r in RK.LARGES(df, "v", by, 1, 450, 4000).collect()}
    assert got == {k: tuple(v[-n] if len(v) >= n else None for n in (1, 450, 4000)) for k, v in want.items()}
    if way == "one round":
        plan = RK.MEDIANS(df, "v", by)._jdf.queryExecution().toString()
        assert "median(" not in plan.lower().replace("as median", "") and "Percentile(" not in plan


def test_whole_table_and_nothing(spark, grouped):
    rows, df = grouped
    all_ = sorted(v for *_, v in rows if v is not None and v == v)
    assert RK.MEDIANS(df, "v").collect()[0][:] == (median(all_), None)
    assert RK.nth(df, 3) == all_[-3] and RK.nth(df, 3, largest=False) == all_[2] and RK.nth(df, 10**6) is None and RK.nth(df, 0) is None
    assert RK.MEDIANS(df.where("false"), "v").collect()[0][:] == (None, "#NUM!") and RK.MEDIANS(df.where("false"), "v", ["part"]).count() == 0
    assert RK.MEDIANS(df, "the.group").collect()[0][:] == (None, "#NUM!")
    assert FL.filter_top(df.select("v"), "v", 2).count() == 2 and FL.filter_top(df.select("v"), "v", 10**6).count() == len(all_)


def test_text_cells_do_not_count(spark):
    df = spark.createDataFrame([("5", 1.0), ("x", 2.0), (None, 3.0)], "t string, n double")
    assert FL.filter_average(df, "t").count() == 0 and FL.filter_average(df, "n").count() == 1 and FL.filter_top(df, "t", 1).count() == 0
    assert [r["color"] for r in FL.color_scale(df, "t", [(0, 0, 0), (255, 255, 255)]).collect()] == [None] * 3
