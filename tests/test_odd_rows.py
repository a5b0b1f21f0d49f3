"""Queries against their SQL on rows that the test tables do not have."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.functions import numfmt
from quillgrid.operators import rebase
from quillgrid.plans import catalogue


def both(spark, path, name, table, frame):
    """Rows of a query over one table, from Spark and from its SQL."""
    frame.to_parquet(f"{path}/{table}.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet'")
    want = c.sql(catalogue.ORACLES[name]).df()
    got = catalogue.QUERIES[name](spark, str(path)).toPandas()[list(want.columns)]
    plain = lambda df: sorted(map(tuple, df.astype(object).itertuples(index=False)))
    return plain(got), plain(want)


def customers(balances):
    n = len(balances)
    return pd.DataFrame({"c_custkey": range(n), "c_name": "C", "c_nationkey": 3, "c_acctbal": [float(x) for x in balances], "c_mktsegment": "M"})


def test_percents_round_once(spark, tmp_path):
    """Balances whose tenth of a percent lies half way: every ten from 5 on."""
    got, want = both(spark, tmp_path, "numfmt_money", "customer", customers([*range(-995, 10000, 10), -0.0, 0.0, 0.04, -0.04]))
    assert got == want
    x = F.lit(725.0) / 10000
    row = spark.range(1).select(numfmt.format_number(x, "0.0%"), numfmt.format_number(F.lit(1_250_000.0), "0.0,,"), numfmt.format_number(F.lit(-0.0), "0.00;(0.00)")).first()
    assert tuple(row) == ("7.3%", "1.3", "0.00")


def test_dollars_of_zero_and_of_large_amounts(spark, tmp_path):
    got, want = both(spark, tmp_path, "text_number", "customer", customers([-0.0, 0.0, -0.01, -0.05, 0.05, 1e15, 1e17, 1e19, -1e18, 1234.56]))
    assert got == want


def test_accounting_formats_of_zero(spark, tmp_path):
    got, want = both(spark, tmp_path, "numfmt_builtin", "customer", customers([0.0, -0.0, 0.5, -0.5, 0.004, 1234.56, -1234.56, 1e17]))
    assert got == want
    assert spark.range(1).select(numfmt.format_number(F.lit(0.0), 44)).first()[0] == " $- "  # the format itself


def test_formulas_below_a_sheets_last_row(spark, tmp_path):
    orders = pd.DataFrame({"o_orderkey": [0, 7, 8, 9, 1_048_570, 1_048_574, 1_048_575, 9_000_000, 3_000_000_000]})
    got, want = both(spark, tmp_path, "formulas_move", "orders", orders)
    assert got == want
    df = spark.createDataFrame([("A1048577+B9+XFD1",)], "f string")
    row = df.select(rebase.copied(F.col("f"), 0, 1).alias("a"), rebase.rows_shifted(F.col("f"), 9, -1).alias("b")).first()
    assert tuple(row) == ("B1048577+C9+#REF!", "A1048576+#REF!+XFD1")
