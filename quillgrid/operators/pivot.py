"""Pivot tables that compute: rows by columns by values, subtotals and grand totals, and the totals row of a table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.aggregates import _num

TOTAL = "Grand Total"

def _of_numbers(function):
    """The function over the numbers of a field: text does not count."""
    return lambda c: function(_num(F.col(c) if isinstance(c, str) else c))


#: The subtotal functions by name.
FUNCTIONS = {
    "average": _of_numbers(F.avg), "count": F.count, "countNums": _of_numbers(F.count), "max": F.max, "min": F.min, "product": _of_numbers(F.product),
    "stdDev": _of_numbers(F.stddev_samp), "stdDevP": _of_numbers(F.stddev_pop), "sum": _of_numbers(F.sum), "var": _of_numbers(F.var_samp), "varP": _of_numbers(F.var_pop),
}


@dataclass
class Pivot:
    """rows and columns are field names; values are (field, function, name); pages are filters field -> allowed items."""

    rows: list[str]
    values: list[tuple[str, str, str]]
    columns: list[str] = field(default_factory=list)
    pages: dict[str, list] = field(default_factory=dict)
    row_totals: bool = True
    column_totals: bool = True

    def validate(self, df: DataFrame) -> None:
        """Raises where a pivot over df would be wrong: no value, unknown fields, a field on two axes."""
        if not self.values:
            raise ValueError("a pivot needs a value field")
        axes = [*self.rows, *self.columns, *self.pages]
        for name in axes:
            if axes.count(name) > 1:
                raise ValueError(f"field {name!r} is on more than one axis")
        for name in [*axes, *(v[0] for v in self.values)]:
            if name not in df.columns:
                raise ValueError(f"no column {name!r}")
        for _, function, _ in self.values:
            if function not in FUNCTIONS:
                raise ValueError(f"no subtotal function {function!r}")

    def _aggregates(self) -> list[Column]:
        return [FUNCTIONS[f](F.col(c)).alias(name) for c, f, name in self.values]

    def long(self, df: DataFrame) -> DataFrame:
        """One row for each combination of members, totals included (their axes read TOTAL, level > 0): rows, columns,
        values, row_level and column_level (1 where that axis is totalled). One grouping-sets aggregate."""
        self.validate(df)
        if self.pages:
            df = df.where(reduce(lambda a, b: a & b, [F.col(c).isin(items) for c, items in self.pages.items()]))
        axes = [*self.rows, *self.columns]
        sets = [axes]
        if self.row_totals:
            sets.append(self.columns)
        if self.column_totals and self.columns:
            sets.append(self.rows)
            if self.row_totals:
                sets.append([])
        inner = df.select(*[F.col(c) for c in dict.fromkeys([*axes, *(v[0] for v in self.values)])])
        grouped = inner.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in axes]).agg(
            *self._aggregates(), *[F.grouping(c).alias(f"level {c}") for c in axes]
        )
        level = lambda names: F.greatest(*[F.col(f"`level {c}`") for c in names], F.lit(0), F.lit(0)).cast("int")
        shown = [F.when(F.col(f"`level {c}`") == 1, TOTAL).otherwise(F.col(c).cast("string")).alias(c) for c in axes]
        return grouped.select(*shown, *[F.col(v[2]) for v in self.values], level(self.rows).alias("row_level"), level(self.columns).alias("column_level"))

    def table(self, df: DataFrame, members: list[str] | None = None) -> DataFrame:
        """The laid-out pivot with one column field: a column for each member (and the total) and value. members saves
        the scan that finds them. Sorted ascending, totals last."""
        if len(self.columns) != 1:
            return self.long(df).orderBy("row_level", *self.rows)
        known = [*members, *([TOTAL] if self.column_totals else [])] if members else None
        wide = self.long(df).groupBy(*self.rows, "row_level").pivot(self.columns[0], known)
        return wide.agg(*[F.first(v[2]).alias(v[2]) for v in self.values]).orderBy("row_level", *self.rows)


def subtotals(df: DataFrame, rows: list[str], values: list[tuple[str, str, str]]) -> DataFrame:
    """Nested subtotals from the last row field to the first, by rollup; `level` is the number of totalled fields."""
    aggregates = [FUNCTIONS[f](F.col(c)).alias(name) for c, f, name in values]
    rolled = df.rollup(*rows).agg(*aggregates, *[F.grouping(c).alias(f"level {c}") for c in rows])
    shown = [F.when(F.col(f"`level {c}`") == 1, TOTAL).otherwise(F.col(c).cast("string")).alias(c) for c in rows]
    level = reduce(lambda a, b: a + b, [F.col(f"`level {c}`").cast("int") for c in rows])
    return rolled.select(*shown, *[F.col(v[2]) for v in values], level.alias("level"))


#: Combinations of items at most.
ITEMS = 1_000_000


def show_empty_items(pivoted: DataFrame, row_items: DataFrame, column_items: DataFrame) -> DataFrame:
    """Every combination of the (distinct) items of two axes, with NULL values where none occurs. Items are members of
    axes, a set the size of a report, not rows: more than ITEMS combinations are refused."""
    numbers = [items.limit(ITEMS + 1).count() for items in (row_items, column_items)]
    if numbers[0] * numbers[1] > ITEMS:
        raise ValueError(f"the pivot would show more than {ITEMS} combinations of items")
    grid = row_items.crossJoin(column_items)
    return grid.join(pivoted, [*row_items.columns, *column_items.columns], "left")


def shared_items(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, items): the number of different non-blank items of each column, in one pass."""
    counts = df.agg(*[F.countDistinct(F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))).alias(c) for c in columns])
    return counts.unpivot([], columns, "field", "items")


def table_totals(df: DataFrame, totals: dict[str, str], label: tuple[str, str] | None = None) -> DataFrame:
    """One row of totals: column -> function (as FUNCTIONS, or none); other columns are NULL, label = (column, text)."""
    aggregates = []
    for name, kind in df.dtypes:
        function = totals.get(name, "none")
        if label and name == label[0]:
            aggregates.append(F.lit(label[1]).alias(name))
        else:
            aggregates.append((F.lit(None).cast(kind) if function == "none" else FUNCTIONS[function](F.col(name))).alias(name))
    literals = df.agg(F.count("*").alias("n"), *[a for a in aggregates])
    return literals.drop("n")
