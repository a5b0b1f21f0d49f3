"""Exact values at ranks within groups: MEDIAN, LARGE, SMALL and quantiles for tables and groups of any size.

All groups and ranks are searched at once. A quantile sketch cuts each group's values into cells, exact counts tell the cell
that holds a rank, and only the rows of such cells are looked at again: a cell is either one value, which is the answer, or lies
strictly between two cuts and holds a small share of the group. No values are shuffled but those of the last cells, no
buffer holds a group's distinct values, and nothing but the largest cell's count comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.cells import NUM
from quillgrid.operators.positions import kept

#: Cuts of a group in one round, and the rank error of the sketch that finds them.
CUTS, ACCURACY = 32, 1000
#: Rows of one cell that a task sorts.
FEW = 100_000
#: Groups whose cuts (CUTS numbers each) are broadcast; the values of more groups are sorted over range partitions instead.
MOST_GROUPS = 20_000
#: Ranks from an end that a heap in each task finds.
HEAP = 10_000

Rank = Callable[[Column], Column]


def _same(names: list[str], other: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{other} {n}"))
    return out


def _renamed(df: DataFrame, names: list[str], other: str) -> DataFrame:
    for n in names:
        df = df.withColumnRenamed(n, f"{other} {n}")
    return df


def _cell(v: Column, cuts: Column) -> Column:
    """2i between the cuts i - 1 and i, 2i + 1 at cut i."""
    below = F.size(F.filter(cuts, lambda c: c < v))
    return below * 2 + F.when(F.get(cuts, below) == v, 1).otherwise(0)


def _search(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """values (keys, v), wanted (keys, name, k), k within the group -> (keys, name, x): the k-th smallest value."""
    fractions = [i / CUTS for i in range(CUTS + 1)]
    cuts = values.groupBy(*keys).agg(F.sort_array(F.array_distinct(F.percentile_approx("v", fractions, ACCURACY))).alias("cuts"))
    cuts = kept(cuts.join(_renamed(wanted.select(*keys).distinct(), keys, "asked"), _same(keys, "asked"), "left_semi"), "cuts")
    own = _renamed(cuts, keys, "cut")
    placed = values.join(F.broadcast(own), _same(keys, "cut")).withColumn("cell", _cell(F.col("v"), F.col("cuts")))
    counts = kept(placed.groupBy(*keys, "cell").agg(F.count("*").alias("n")), "cells")  # 2 * CUTS + 3 rows a group at most
    upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    reached = _renamed(counts.withColumn("reached", F.sum("n").over(upto)), keys, "count")
    found = wanted.join(reached, _same(keys, "count")).where((F.col("k") <= F.col("reached")) & (F.col("k") > F.col("reached") - F.col("n")))
    found = found.select(*keys, "name", (F.col("k") - F.col("reached") + F.col("n")).alias("k"), "cell", "n")
    found = kept(found.join(F.broadcast(own), _same(keys, "cut")).select(*keys, "name", "k", "cell", "n", "cuts"), "found")
    at_cut = found.where("cell % 2 = 1").select(*keys, "name", F.get("cuts", F.shiftright("cell", 1)).alias("x"))
    open_ = found.where("cell % 2 = 0")
    largest = open_.agg(F.max("n").alias("n")).first()["n"]
    if largest is None:
        return at_cut
    # A cell that is asked for more than once is taken once.
    cells = _renamed(open_.groupBy(*keys, "cell").agg(F.first("n").alias("n")), [*keys, "cell"], "open").drop("n")
    inner = [*keys, f"cell {len(keys)}"]
    rest = placed.join(F.broadcast(cells), _same([*keys, "cell"], "open")).select(*keys, F.col("cell").alias(inner[-1]), "v")
    asked = open_.select(*keys, F.col("cell").alias(inner[-1]), "name", "k")
    if largest <= FEW:
        ranked = rest.withColumn("at", F.row_number().over(Window.partitionBy(*inner).orderBy("v")))
        ranked = _renamed(ranked, inner, "row")
        deeper = asked.join(ranked, _same(inner, "row") & (F.col("k") == F.col("at"))).select(*keys, "name", F.col("v").alias("x"))
    else:
        deeper = _search(kept(rest, "bracket"), asked, inner).select(*keys, "name", "x")
    return at_cut.unionByName(deeper)


def _by_sort(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """As _search, for very many groups: equal values are counted first, and a running count is kept over range partitions."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = values.groupBy(*keys, "v").agg(F.count("*").alias("n"))
    placed = kept(counts.repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()), "sorted")
    inside = Window.partitionBy("part", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("part", *keys).agg(F.sum("n").alias("n")).select("part", *keys, F.sum("n").over(earlier).alias("base")).where("base IS NOT NULL")
    # Only a group that goes on from one partition to the next has a base: one a partition at most.
    base = F.broadcast(_renamed(base, ["part", *keys], "base"))
    reached = placed.withColumn("reached", F.sum("n").over(inside)).join(base, _same(["part", *keys], "base"), "left").withColumn("reached", F.col("reached") + F.coalesce("base", F.lit(0)))
    reached = _renamed(reached.select(*keys, "v", "n", "reached"), keys, "row")
    return wanted.join(reached, _same(keys, "row")).where((F.col("k") <= F.col("reached")) & (F.col("k") > F.col("reached") - F.col("n"))).select(*keys, "name", F.col("v").alias("x"))


def at_ranks(df: DataFrame, column: Column, by: list[str], ranks: dict[str, Rank]) -> DataFrame:
    """(by, n, one column for each rank): the values at ranks counted from the smallest, each a function of the group's count
    of numbers. A rank outside the group is NULL, and so are all of a group without numbers; blanks, undefined numbers and
    text count for none. Without `by` there is one row."""
    keys = [f"group {i}" for i in range(max(1, len(by)))]
    groups = [F.col(f"`{c}`") for c in by] or [F.lit(0)]
    rows = kept(df.select(*[g.alias(k) for g, k in zip(groups, keys, strict=True)], column.alias("v")), "values")
    sizes = kept(rows.groupBy(*keys).agg(F.count_if(F.col("v").isNotNull() & ~F.isnan("v")).alias("n")), "sizes")
    values = rows.where("v IS NOT NULL AND NOT isnan(v)")
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("long").alias("k")) for name, rank in ranks.items()]))
    wanted = sizes.select(*keys, "n", each.alias("r")).select(*keys, "n", "r.name", "r.k").where("k BETWEEN 1 AND n").drop("n")
    few = sizes.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS
    found = (_search if few else _by_sort)(values, wanted, keys)
    wide = _renamed(found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in ranks]), keys, "found")
    out = sizes.join(wide, _same(keys, "found"), "left").select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=False)], "n", *ranks)
    if by:
        return out
    return df.sparkSession.range(1).select().join(out, F.lit(True), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _number(df: DataFrame, column: str) -> Column:
    c = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() in ("string", "varchar", "char"):
        return F.lit(None).cast("double")
    return c.try_cast("double")


def MEDIANS(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, median, error): #NUM! for a group without numbers."""
    found = at_ranks(df, _number(df, column), by or [], {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1})
    return found.select(*[F.col(f"`{c}`") for c in by or []], ((F.col("low") + F.col("high")) / 2).alias("median"), F.when(F.col("n") == 0, F.lit(NUM)).alias("error"))


def LARGES(df: DataFrame, column: str, by: list[str], *ks: int) -> DataFrame:
    """(by, large_k for each k): the k-th largest numbers of each group, NULL where it has fewer."""
    found = at_ranks(df, _number(df, column), by, {f"large_{k}": (lambda n, k=k: n + 1 - k) for k in ks})
    return found.drop("n")


def SMALLS(df: DataFrame, column: str, by: list[str], *ks: int) -> DataFrame:
    """(by, small_k for each k): the k-th smallest numbers of each group, NULL where it has fewer."""
    found = at_ranks(df, _number(df, column), by, {f"small_{k}": (lambda n, k=k: F.lit(k)) for k in ks})
    return found.drop("n")


def nth(values: DataFrame, n: int, largest: bool = True) -> float | None:
    """The n-th largest (smallest) of values (v), None if there are fewer: by a heap in each task for the first HEAP."""
    if n < 1:
        return None
    if n <= HEAP:
        ends = values.where("v IS NOT NULL AND NOT isnan(v)").orderBy(F.desc("v") if largest else F.asc("v")).limit(n)
        row = ends.agg(F.count("v").alias("n"), (F.min("v") if largest else F.max("v")).alias("x")).first()
        return row["x"] if row["n"] == n else None
    return at_ranks(values, F.col("v"), [], {"x": (lambda m: m + 1 - n) if largest else (lambda m: F.lit(n))}).first()["x"]
