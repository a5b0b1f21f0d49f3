"""Range aggregates as Spark aggregate expressions.

Each takes one or more columns of a DataFrame (a range may span several) and returns a Column for df.agg(...), so any
number of them run in one pass with map-side partial aggregation. The kind of a column decides what its cells are: text
and blanks do not count, booleans are 1 and 0 (COUNT and PRODUCT skip them), and for the A-forms text is 0. The kind is
a constant to the optimizer, so a numeric column stays a bare aggregate. `numbers` does the same for cell tables, whose
cells are of mixed kinds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions.cells import DIV0, NUM
from quillgrid.operators import ranks


def _cols(columns) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in columns]


def _num(c: Column) -> Column:
    """The numbers of a column: none of a text column, 1 and 0 of a boolean one."""
    return F.when(F.typeof(c) == "string", F.lit(None).cast("double")).otherwise(c.try_cast("double"))


def _only(c: Column) -> Column:
    """As _num, but none of a boolean column."""
    return F.when(F.typeof(c) != "boolean", _num(c))


def _every(c: Column) -> Column:
    """As _num, but text is 0."""
    return F.when(F.typeof(c) == "string", F.when(c.isNotNull(), F.lit(0.0))).otherwise(c.try_cast("double"))


def numbers(every: bool = False, booleans: bool = True) -> Column:
    """The numbers of a cell table (columns kind, num, bool) for any of the aggregates: booleans are 1 and 0 or, as for
    COUNT and PRODUCT, none; with `every`, as for the A-forms, text is 0."""
    kind = F.col("kind")
    out = F.when(kind == "n", F.col("num"))
    out = out.when(kind == "b", F.col("bool").cast("double")) if booleans else out
    return out.when(kind == "s", F.lit(0.0)) if every else out


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def SUM(*columns) -> Column:
    return _add([F.coalesce(F.sum(_num(c)), F.lit(0.0)) for c in _cols(columns)])


def COUNT(*columns) -> Column:
    """Of numbers; booleans do not count."""
    return _add([F.count(_only(c)) for c in _cols(columns)])


def COUNTA(*columns) -> Column:
    """Of whatever is not blank."""
    return _add([F.count(c) for c in _cols(columns)])


def _terms(columns) -> Column:
    return _add([F.count(_num(c)) for c in _cols(columns)])


def COUNTBLANK(column) -> Column:
    c = _cols([column])[0]
    return F.count_if(c.isNull() | (c.cast("string") == ""))


def AVERAGE(*columns) -> Column:
    n = _terms(columns)
    return F.when(n > 0, SUM(*columns) / F.when(n > 0, n))


def AVERAGEA(column) -> Column:
    """Text counts as 0."""
    return F.avg(_every(_cols([column])[0]))


def MAX(*columns) -> Column:
    return F.coalesce(F.greatest(*[F.max(_num(c)) for c in _cols(columns)], F.lit(None).cast("double")), F.lit(0.0))


def MIN(*columns) -> Column:
    return F.coalesce(F.least(*[F.min(_num(c)) for c in _cols(columns)], F.lit(None).cast("double")), F.lit(0.0))


def MAXA(*columns) -> Column:
    """Text counts as 0."""
    return MAX(*[_every(c) for c in _cols(columns)])


def MINA(*columns) -> Column:
    """Text counts as 0."""
    return MIN(*[_every(c) for c in _cols(columns)])


def PRODUCT(column) -> Column:
    c = _only(_cols([column])[0])
    return F.when(F.count(c) == 0, 0.0).otherwise(F.product(c))


def SUMSQ(*columns) -> Column:
    return _add([F.coalesce(F.sum(_num(c) * _num(c)), F.lit(0.0)) for c in _cols(columns)])


def SUMPRODUCT(*columns) -> Column:
    """Of columns of the same rows; what is no number counts as 0."""
    return F.coalesce(F.sum(reduce(lambda a, b: a * b, [F.coalesce(_num(c), F.lit(0.0)) for c in _cols(columns)])), F.lit(0.0))


def _two(x, y):
    return [F.coalesce(_num(c), F.lit(0.0)) for c in _cols([x, y])]


def SUMX2MY2(x, y) -> Column:
    a, b = _two(x, y)
    return F.coalesce(F.sum(a * a - b * b), F.lit(0.0))


def SUMX2PY2(x, y) -> Column:
    a, b = _two(x, y)
    return F.coalesce(F.sum(a * a + b * b), F.lit(0.0))


def SUMXMY2(x, y) -> Column:
    a, b = _two(x, y)
    return F.coalesce(F.sum((a - b) * (a - b)), F.lit(0.0))


def MEDIAN(column) -> Column:
    return F.median(_num(_cols([column])[0]))


def STDEV(column) -> Column:
    return F.stddev_samp(_num(_cols([column])[0]))


def STDEVP(column) -> Column:
    return F.stddev_pop(_num(_cols([column])[0]))


def VAR(column) -> Column:
    return F.var_samp(_num(_cols([column])[0]))


def VARP(column) -> Column:
    return F.var_pop(_num(_cols([column])[0]))


def STDEVA(column) -> Column:
    """Text counts as 0, as in the next three."""
    return F.stddev_samp(_every(_cols([column])[0]))


def STDEVPA(column) -> Column:
    return F.stddev_pop(_every(_cols([column])[0]))


def VARA(column) -> Column:
    return F.var_samp(_every(_cols([column])[0]))


def VARPA(column) -> Column:
    return F.var_pop(_every(_cols([column])[0]))


STDEV_S, STDEV_P, VAR_S, VAR_P = STDEV, STDEVP, VAR, VARP


def DEVSQ(column) -> Column:
    c = _num(_cols([column])[0])
    return F.var_pop(c) * F.count(c)


def GEOMEAN(column) -> Column:
    """NULL (with GEOMEAN_ERROR #NUM!) if any number is not positive."""
    c = _num(_cols([column])[0])
    return F.when((F.count(c) > 0) & (F.min(c) > 0), F.exp(F.avg(F.ln(F.when(c > 0, c)))))


def average_error(*columns) -> Column:
    """#DIV/0! where AVERAGE has nothing to average."""
    return F.when(_terms(columns) == 0, F.lit(DIV0))


def spread_error(column, least: int = 2) -> Column:
    """#DIV/0! where there are fewer than `least` numbers for a variance or deviation."""
    return F.when(F.count(_num(_cols([column])[0])) < least, F.lit(DIV0))


def empty_error(column) -> Column:
    """#NUM! where MEDIAN, DEVSQ, AVEDEV or GEOMEAN have no number."""
    return F.when(F.count(_num(_cols([column])[0])) == 0, F.lit(NUM))


#: Values that one group of a fold holds at most, about.
FOLD = 256


def GCD_LCM(df: DataFrame, column: str) -> DataFrame:
    """(gcd, lcm) of a column of whole numbers; #NUM! for one out of [0, 2^53) is left to the caller's guard. Distinct
    values are folded in groups of about FOLD, the results again, until one is left, so no group grows with the table."""
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def gcd(a, b):
        step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, one).otherwise(s["y"])).alias("y")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(a.alias("x"), b.alias("y")), step)["x"]

    def lcm(a, b):
        return F.when((a == 0) | (b == 0), zero).otherwise(F.floor(a / gcd(a, b)) * b)

    x = F.floor(F.col(column).cast("double")).cast("bigint")
    live = df.select(x.alias("g"), x.alias("l")).where("g IS NOT NULL").distinct()
    n = live.count()
    while n > FOLD:
        n = -(-n // FOLD)
        parts = live.groupBy(F.pmod(F.xxhash64("g", "l"), F.lit(n)).alias("part")).agg(F.collect_list("g").alias("gs"), F.collect_list("l").alias("ls"))
        live = parts.select(F.aggregate("gs", zero, gcd).alias("g"), F.aggregate("ls", one, lcm).alias("l"))
    whole = live.agg(F.collect_list("g").alias("gs"), F.collect_list("l").alias("ls"))
    return whole.select(F.aggregate("gs", zero, gcd).cast("double").alias("gcd"), F.aggregate("ls", one, lcm).cast("double").alias("lcm"))


def nth_largest(df: DataFrame, column: str, n: int) -> float | None:
    """The n-th largest number (ties counted one by one), None if there are fewer."""
    return ranks.nth(df.select(_num(F.col(column)).alias("v")), n)


def MEDIAN_OF(df: DataFrame, column: str) -> DataFrame:
    """(median): as MEDIAN, which holds all distinct values of a group in one buffer, but for tables of any size."""
    return ranks.MEDIANS(df, column).select("median")


def AVEDEV(df: DataFrame, column: str) -> DataFrame:
    """(avedev): mean distance from the mean, in two passes; the mean is one row. NULL where there is no number."""
    c = _num(F.col(column))
    mean = df.agg(F.avg(c).alias("mean"))
    return df.join(F.broadcast(mean)).agg(F.avg(F.abs(c - F.col("mean"))).alias("avedev"))


def _ranked(df: DataFrame, found: float | None, name: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(found, None if found is not None else NUM)], f"{name} double, error string")


def LARGE(df: DataFrame, column: str, k: int) -> DataFrame:
    """(large, error): the k-th largest number, NULL and #NUM! if there is none."""
    return _ranked(df, nth_largest(df, column, k), "large")


def SMALL(df: DataFrame, column: str, k: int) -> DataFrame:
    """(small, error): the k-th smallest number."""
    return _ranked(df, ranks.nth(df.select(_num(F.col(column)).alias("v")), k, largest=False), "small")


#: The range functions by their spreadsheet names.
RANGE_FUNCTIONS = {
    "SUM": SUM, "COUNT": COUNT, "COUNTA": COUNTA, "COUNTBLANK": COUNTBLANK, "AVERAGE": AVERAGE, "AVERAGEA": AVERAGEA, "MAX": MAX, "MIN": MIN, "MAXA": MAXA,
    "MINA": MINA, "PRODUCT": PRODUCT, "SUMSQ": SUMSQ, "SUMPRODUCT": SUMPRODUCT, "SUMX2MY2": SUMX2MY2, "SUMX2PY2": SUMX2PY2, "SUMXMY2": SUMXMY2,
    "MEDIAN": MEDIAN, "STDEV": STDEV, "STDEV.S": STDEV, "STDEVP": STDEVP, "STDEV.P": STDEVP, "STDEVA": STDEVA, "STDEVPA": STDEVPA, "VAR": VAR, "VAR.S": VAR,
    "VARP": VARP, "VAR.P": VARP, "VARA": VARA, "VARPA": VARPA, "DEVSQ": DEVSQ, "GEOMEAN": GEOMEAN,
}


def call(name: str, *columns) -> Column:
    """A range function by name, in any case, as an aggregate of columns; KeyError if there is none."""
    return RANGE_FUNCTIONS[name.upper()](*columns)


#: Function numbers of SUBTOTAL.
SUBTOTALS = {1: AVERAGE, 2: COUNT, 3: COUNTA, 4: MAX, 5: MIN, 6: PRODUCT, 7: STDEV, 8: STDEVP, 9: SUM, 10: VAR, 11: VARP}


def SUBTOTAL(code: int, column) -> Column:
    """The aggregate of that number; 101 to 111 are the same (a DataFrame has no hidden rows)."""
    return SUBTOTALS[code % 100](column)
