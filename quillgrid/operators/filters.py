"""Auto-filters, conditional formats and data validation as filters, flags and counts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.operators import ranks
from quillgrid.operators.aggregates import _num
from quillgrid.operators.criteria import criterion

EPSILON = 1e-9


def filter_values(df: DataFrame, column: str, values: list, blanks: bool = False) -> DataFrame:
    """Rows whose cell is in the list, blanks perhaps."""
    c = F.col(column)
    hit = c.isin(values)
    return df.where(hit | c.isNull() if blanks else hit)


def filter_custom(df: DataFrame, column: str, *wanted, both: bool = True) -> DataFrame:
    """Rows that meet one or two comparisons (criterion strings), joined by AND or OR."""
    tests = [criterion(df, column, w) for w in wanted]
    return df.where(reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), tests))


def filter_top(df: DataFrame, column: str, n: float, bottom: bool = False, percent: bool = False) -> DataFrame:
    """The rows of the n largest (smallest) values, ties at the edge included; with percent, of ceil(n% of the rows).

    The edge value is found by a heap in each task for small n and by narrowing a bracket beyond, so neither a window nor one
    task's sort spans the table. Text has no place among the numbers.
    """
    c = F.col(column)
    if percent:
        n = math.ceil(df.where(c.isNotNull()).count() * n / 100)
    if int(n) < 1:
        return df.limit(0)
    edge = ranks.nth(df.select(_num(c).alias("v")), int(n), largest=not bottom)
    if edge is None:
        return df.where(_num(c).isNotNull() & ~F.isnan(_num(c)))
    return df.where(_num(c) <= edge if bottom else (_num(c) >= edge) & ~F.isnan(_num(c)))


def filter_average(df: DataFrame, column: str, above: bool = True) -> DataFrame:
    """Rows above (below) the column's average; text counts for none."""
    c = _num(F.col(column))
    mean = df.agg(F.avg(c).alias("rule mean"))
    return df.join(F.broadcast(mean), c > F.col("rule mean") if above else c < F.col("rule mean")).drop("rule mean")


def filter_dates(df: DataFrame, column: str, kind: str, today: str | None = None) -> DataFrame:
    """Dynamic date filters: today, yesterday, tomorrow, thisMonth, lastMonth, nextMonth, thisYear, lastYear, nextYear,
    M1 to M12 and Q1 to Q4 of any year. today is an ISO date, the current one by default."""
    day, now = F.col(column).cast("date"), F.lit(today).cast("date") if today else F.current_date()
    if kind[0] in "MQ" and kind[1:].isdigit():
        return df.where((F.month(day) if kind[0] == "M" else F.quarter(day)) == int(kind[1:]))
    days = {"yesterday": -1, "today": 0, "tomorrow": 1}
    if kind in days:
        return df.where(day == F.date_add(now, days[kind]))
    shift, unit = {"last": -1, "this": 0, "next": 1}[kind[:4]], kind[4:].lower()
    start = F.trunc(F.add_months(now, shift * (12 if unit == "year" else 1)), unit)
    stop = F.add_months(start, 12 if unit == "year" else 1)
    return df.where((day >= start) & (day < stop))


def cell_is(column: str, op: str, a, b=None) -> Column:
    """The flag of a cell rule: equal, notEqual, greaterThan, ..., between, notBetween, containsText, notContainsText,
    beginsWith, endsWith."""
    c = F.col(column)
    tests = {
        "equal": lambda: F.abs(c - a) < EPSILON if not isinstance(a, str) else c == a,
        "notEqual": lambda: F.abs(c - a) >= EPSILON if not isinstance(a, str) else c != a,
        "greaterThan": lambda: c > a, "lessThan": lambda: c < a, "greaterThanOrEqual": lambda: c >= a, "lessThanOrEqual": lambda: c <= a,
        "between": lambda: c.between(min(a, b), max(a, b)), "notBetween": lambda: ~c.between(min(a, b), max(a, b)),
        "containsText": lambda: F.lower(c).contains(a.lower()), "notContainsText": lambda: ~F.lower(c).contains(a.lower()),
        "beginsWith": lambda: F.lower(c).startswith(a.lower()), "endsWith": lambda: F.lower(c).endswith(a.lower()),
        "containsBlanks": lambda: c.isNull(), "notContainsBlanks": lambda: c.isNotNull(),
    }
    return F.coalesce(tests[op](), F.lit(False))


def _with_bounds(df: DataFrame, column: str) -> DataFrame:
    c = _num(F.col(column))
    bounds = df.agg(F.min(c).alias("rule low"), F.max(c).alias("rule high"))
    return df.join(F.broadcast(bounds))


def _position() -> Column:
    span = F.col("rule high") - F.col("rule low")
    return lambda c: F.when(span == 0, 0.5).otherwise((c - F.col("rule low")) / F.when(span == 0, 1.0).otherwise(span))


def color_scale(df: DataFrame, column: str, colors: list[tuple[int, int, int]], name: str = "color") -> DataFrame:
    """df with #RRGGBB between two or three colours by the cell's place between the column's least and greatest."""
    at = _position()(_num(F.col(column)))
    scaled = at * (len(colors) - 1)
    place = F.least(F.floor(scaled), F.lit(len(colors) - 2)).cast("int")
    parts = []
    for channel in range(3):
        own = F.array(*[F.lit(float(c[channel])) for c in colors])
        low, high = F.get(own, place), F.get(own, place + 1)
        parts.append(F.lpad(F.hex(F.floor(low + (high - low) * (scaled - place) + 0.5).cast("bigint")), 2, "0"))
    return _with_bounds(df, column).withColumn(name, F.when(_num(F.col(column)).isNotNull(), F.concat(F.lit("#"), *parts))).drop("rule low", "rule high")


def data_bar(df: DataFrame, column: str, least: float = 10.0, most: float = 90.0, name: str = "bar") -> DataFrame:
    """df with the length of the cell's bar, from least to most percent."""
    at = _position()(_num(F.col(column)))
    return _with_bounds(df, column).withColumn(name, least + at * (most - least)).drop("rule low", "rule high")


def icon_set(df: DataFrame, column: str, icons: int = 3, reverse: bool = False, name: str = "icon") -> DataFrame:
    """df with the icon number 0 to icons - 1; the cut points are .33 and .67, quarters, or fifths."""
    cuts = {3: [0.33, 0.67], 4: [0.25, 0.5, 0.75], 5: [0.2, 0.4, 0.6, 0.8]}[icons]
    at = _position()(_num(F.col(column)))
    icon = reduce(lambda a, b: a + b, [(at >= cut).cast("int") for cut in cuts])
    return _with_bounds(df, column).withColumn(name, icons - 1 - icon if reverse else icon).drop("rule low", "rule high")


def duplicates(df: DataFrame, column: str, unique: bool = False) -> DataFrame:
    """Rows whose value occurs more than once (unique: just once): a count by value joined back, which splits where one
    value is very frequent."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("dup value")).agg(F.count("*").alias("dup n"))
    picked = counts.where("`dup n` = 1" if unique else "`dup n` > 1").select("dup value")
    return df.join(picked, F.col(column) == F.col("dup value"), "left_semi")


#: Parts of a group whose largest values are found apart from each other.
SALTS = 64


def rank_flags(df: DataFrame, column: str, by: list[str], n: int, name: str = "top") -> DataFrame:
    """df with a flag on the n largest values within each group of `by`, ties at the edge included.

    The n largest of each of a group's parts are found first, the group's n-th largest among those, so a group of very
    many rows is not ranked in one task.
    """
    keys = [F.col(k).alias(f"rank {i}") for i, k in enumerate(by)]
    names = [f"rank {i}" for i in range(len(by))]
    values = df.select(*keys, F.col(column).alias("rank value"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("rank part"))
    order = F.desc_nulls_last("rank value")
    best = values.withColumn("rank at", F.row_number().over(Window.partitionBy(*names, "rank part").orderBy(order))).where(F.col("rank at") <= n)
    best = best.withColumn("rank at", F.row_number().over(Window.partitionBy(*names).orderBy(order))).where(F.col("rank at") <= n)
    edges = best.groupBy(*names).agg(F.min("rank value").alias("rank edge"), F.count("rank value").alias("rank n"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(by, names, strict=True)])
    flag = F.coalesce(F.col(column) >= F.col("rank edge"), F.col("rank n") < n)  # blanks come last
    return df.join(edges, same, "left").withColumn(name, flag).drop(*names, "rank edge", "rank n")


def validation(column: str, kind: str, op: str = "between", a=None, b=None, blanks: bool = True, items: list | None = None) -> Column:
    """True where a cell meets a validation rule of kind list, whole, decimal, date, textLength or custom (a: a Column)."""
    c = F.col(column)
    if kind == "custom":
        test = a
    elif kind == "list":
        test = c.isin(items)
    else:
        x = F.length(c.cast("string")) if kind == "textLength" else c
        tests = {
            "between": lambda: x.between(a, b), "notBetween": lambda: ~x.between(a, b), "equal": lambda: x == a, "notEqual": lambda: x != a,
            "greaterThan": lambda: x > a, "lessThan": lambda: x < a, "greaterThanOrEqual": lambda: x >= a, "lessThanOrEqual": lambda: x <= a,
        }
        test = tests[op]()
        if kind == "whole":
            test = test & (c == F.floor(c))
    return F.when(c.isNull(), F.lit(blanks)).otherwise(F.coalesce(test, F.lit(False)))


def validation_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, valid, invalid) of named rules, in one pass."""
    flags = df.agg(F.map_from_arrays(F.array(*[F.lit(n) for n in rules]), F.array(*[F.count_if(r) for r in rules.values()])).alias("valid"), F.count("*").alias("n"))
    return flags.select(F.explode("valid").alias("rule", "valid"), "n").select("rule", "valid", (F.col("n") - F.col("valid")).alias("invalid"))
