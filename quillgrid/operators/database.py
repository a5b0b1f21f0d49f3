"""Database functions: an aggregate of one field over the rows that meet a criteria block.

Each returns a one-row DataFrame (value, error). The block is a filter below a partial aggregate, so it reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.cells import DIV0, NUM, VALUE
from quillgrid.operators.criteria import block


def field_name(df: DataFrame, field: str | int) -> str:
    """A column by name (without case) or 1-based index."""
    if isinstance(field, int):
        return df.columns[field - 1]
    return {c.lower(): c for c in df.columns}[field.lower()]


def _run(df: DataFrame, field, lines, value, error=None) -> DataFrame:
    c = F.col(field_name(df, field))
    x: Column = c.cast("double") if dict(df.dtypes)[field_name(df, field)] not in ("string", "boolean") else F.lit(None).cast("double")
    hit = df.where(block(df, lines))
    failed = error(c, x) if error is not None else F.lit(None).cast("string")
    return hit.agg(value(c, x).alias("value"), failed.alias("error")).select(F.when(F.col("error").isNull(), F.col("value")).alias("value"), "error")


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def DSUM(df, field, lines):
    return _run(df, field, lines, lambda c, x: _or_zero(F.sum(x)))


def DAVERAGE(df, field, lines):
    return _run(df, field, lines, lambda c, x: _or_zero(F.avg(x)))


def DCOUNT(df, field, lines):
    """field None counts all rows that match."""
    if field is None:
        return df.where(block(df, lines)).agg(F.count("*").cast("double").alias("value"), F.lit(None).cast("string").alias("error"))
    return _run(df, field, lines, lambda c, x: F.count(x).cast("double"))


def DCOUNTA(df, field, lines):
    return _run(df, field, lines, lambda c, x: F.count(c).cast("double"))


def DMAX(df, field, lines):
    return _run(df, field, lines, lambda c, x: _or_zero(F.max(x)))


def DMIN(df, field, lines):
    return _run(df, field, lines, lambda c, x: _or_zero(F.min(x)))


def DPRODUCT(df, field, lines):
    return _run(df, field, lines, lambda c, x: F.when(F.count(x) == 0, 0.0).otherwise(F.product(x)))


def _few(c: Column, x: Column) -> Column:
    return F.when(F.count(x) < 2, F.lit(DIV0))


def DSTDEV(df, field, lines):
    return _run(df, field, lines, lambda c, x: F.stddev_samp(x), _few)


def DSTDEVP(df, field, lines):
    return _run(df, field, lines, lambda c, x: F.stddev_pop(x), _few)


def DVAR(df, field, lines):
    return _run(df, field, lines, lambda c, x: F.var_samp(x), _few)


def DVARP(df, field, lines):
    return _run(df, field, lines, lambda c, x: F.var_pop(x), _few)


def DGET(df, field, lines):
    """The one value of the matching rows: none #VALUE!, several #NUM!. The value keeps its type."""
    return _run(df, field, lines, lambda c, x: F.min(c), lambda c, x: F.when(F.count(c) == 0, F.lit(VALUE)).when(F.count(c) > 1, F.lit(NUM)))
