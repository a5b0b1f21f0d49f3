"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from quillgrid.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "~"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "isoformat"):
            return v.isoformat()[:19]
        try:
            return f"{round(float(v), 4) + 0.0:.4f}"
        except (TypeError, ValueError):
            return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got.columns)
        return
    want = db.sql(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_whole_tables(spark, tmp_path):
    """No row of lineitem is left out, whatever its key."""
    n = 5000
    rows_ = [(k, 1, 10.0 * k + 0.25, float(k % 50 + 1), "RAN"[k % 3], "OF"[k % 2], k % 9 / 100) for k in range(1, n + 1)]
    names = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus", "l_tax"]
    spark.createDataFrame(pd.DataFrame(rows_, columns=names)).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {name: catalogue.QUERIES[name](spark, str(tmp_path)).toPandas() for name in ("scalar_round", "cf_flags", "lint_cache_mismatch", "product_by_flag")}
    for name in ("scalar_round", "cf_flags"):
        assert sorted(got[name]["l_orderkey"]) == list(range(1, n + 1)), name
    differs = [k for k, _, price, quantity, *_ in rows_ if abs(price - round(price / quantity, 1) * quantity) > 1e-9]
    assert max(differs) > 4900 and sorted(got["lint_cache_mismatch"]["l_orderkey"]) == differs
    grown = dict(got["product_by_flag"].itertuples(index=False))
    for flag in "RAN":
        want = sum(math.log1p(x[6] / 1e6) for x in rows_ if x[4] == flag) * 1e6
        assert abs(grown[flag] - want) < 2e-3


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
