"""Criteria as filter columns: the strings of COUNTIF and the blocks of the database functions.

Both become plain comparisons where they can, so they are pushed down to Parquet scans.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.aggregates import _num

_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")


def _as_number(text: str) -> float | None:
    return float(text) if _NUMBER.match(text.strip()) else None


def wildcard_regex(pattern: str) -> str:
    """Anchored regular expression of a pattern with * and ?, without case."""
    return "(?is)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def _kind(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType.typeName()
    return "text" if kind in ("string", "varchar", "char") else "bool" if kind == "boolean" else "num"


def _text_equal(c: Column, wanted: str) -> Column:
    if "*" in wanted or "?" in wanted:
        return c.rlike(wildcard_regex(wanted))
    if wanted.lower() == wanted.upper():
        return c == wanted  # no letters: a plain equality is pushed down
    return F.lower(c) == wanted.lower()


def criterion(df: DataFrame, column: str, wanted) -> Column:
    """A COUNTIF criterion: a number, boolean, None (which means = 0), or text that may begin with <> >= <= = > <.

    Numbers match numeric cells and text cells that hold the number; `<>x` is true for cells of other kinds, blanks
    included; `=` alone matches blanks and `<>` alone what is not blank.
    """
    c, kind = F.col(column), _kind(df, column)
    if wanted is None:
        wanted = 0.0
    if isinstance(wanted, bool):
        return F.coalesce(c == wanted, F.lit(False)) if kind == "bool" else F.lit(False)
    if isinstance(wanted, str):
        op = next((o for o in ("<>", ">=", "<=", "=", ">", "<") if wanted.startswith(o)), "")
        body = wanted[len(op) :]
        op = op or "="
        value = _as_number(body)
    else:
        op, body, value = "=", str(wanted), float(wanted)
    if body == "":
        empty = c.isNull() | (c == "") if kind == "text" else c.isNull()
        return {"=": empty, "<>": ~empty}.get(op, F.lit(False))
    if kind == "bool":
        said = {"true": True, "false": False}.get(body.lower())
        if said is None or op not in ("=", "<>"):
            return F.lit(op == "<>")
        return F.coalesce(c == said, F.lit(False)) if op == "=" else F.coalesce(c != said, F.lit(True))
    if value is not None:
        x = c if kind == "num" else F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(c).try_cast("double"))
        if op == "=":
            return x == value
        if op == "<>":
            return F.coalesce(x != value, F.lit(True))
        return {">": x > value, "<": x < value, ">=": x >= value, "<=": x <= value}[op]
    if kind == "num":
        return F.lit(op == "<>")
    if op == "=":
        return _text_equal(c, body)
    if op == "<>":
        return ~F.coalesce(_text_equal(c, body), F.lit(False))
    a, b = F.upper(c), body.upper()
    return {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def criteria(df: DataFrame, *pairs) -> Column:
    """criteria(df, column, wanted, column, wanted, ...): all of them."""
    return reduce(lambda a, b: a & b, [criterion(df, c, w) for c, w in zip(pairs[::2], pairs[1::2], strict=True)])


def COUNTIF(df: DataFrame, column: str, wanted) -> Column:
    return F.count_if(criterion(df, column, wanted))


def COUNTIFS(df: DataFrame, *pairs) -> Column:
    return F.count_if(criteria(df, *pairs))


def SUMIF(df: DataFrame, column: str, wanted, summed: str | None = None) -> Column:
    """Text in the summed column does not count, as in the next two."""
    return F.coalesce(F.sum(F.when(criterion(df, column, wanted), _num(F.col(summed or column)))), F.lit(0.0))


def SUMIFS(df: DataFrame, summed: str, *pairs) -> Column:
    return F.coalesce(F.sum(F.when(criteria(df, *pairs), _num(F.col(summed)))), F.lit(0.0))


def AVERAGEIFS(df: DataFrame, averaged: str, *pairs) -> Column:
    return F.avg(F.when(criteria(df, *pairs), _num(F.col(averaged))))


def _condition(df: DataFrame, column: str, wanted) -> Column:
    """A database condition: <= >= < > compare numbers only; <> and = numbers, or text without case; `=` alone is blank;
    plain text is a whole wildcard match; booleans never match."""
    c, kind = F.col(column), _kind(df, column)
    if wanted is None or wanted == "":
        return F.lit(True)
    if not isinstance(wanted, str):
        return F.coalesce(c == float(wanted), F.lit(False)) if kind == "num" else F.lit(False)
    op = next((o for o in ("<>", ">=", "<=", "=", ">", "<") if wanted.startswith(o)), "")
    body = wanted[len(op) :]
    value = _as_number(body)
    if op in (">=", "<=", ">", "<"):
        if kind != "num" or value is None:
            return F.lit(False)
        return F.coalesce({">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value}[op], F.lit(False))
    if op == "=" and body == "":
        return c.isNull()
    if op == "<>" and body == "":
        return c.isNotNull()
    if value is not None:
        equal = c == value if kind == "num" else F.lit(False)
    elif kind != "text":
        equal = F.lit(False)
    else:
        equal = F.lower(c) == body.lower() if op else _text_equal(c, body)
    equal = F.coalesce(equal, F.lit(False))
    return ~equal if op == "<>" else equal


def block(df: DataFrame, lines: list[dict]) -> Column:
    """A criteria block: a row meets any line, and all conditions of that line; no lines means all rows.

    Headers are matched without case; an unknown one raises, as the block then has no meaning.
    """
    names = {c.lower(): c for c in df.columns}
    if not lines:
        return F.lit(True)
    each = []
    for line in lines:
        for header in line:
            if header.lower() not in names:
                raise ValueError(f"no column {header!r}")
        each.append(reduce(lambda a, b: a & b, [_condition(df, names[h.lower()], w) for h, w in line.items()], F.lit(True)))
    return reduce(lambda a, b: a | b, each)
