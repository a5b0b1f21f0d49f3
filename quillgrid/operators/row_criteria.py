"""COUNTIFS, SUMIFS and AVERAGEIFS whose criteria come from each row: `=SUMIFS(price, region, A2, date, "<="&B2)` down a column.

Equal criteria are the key of one join with pre-aggregated rows. A bound becomes a running total by key and value: table and
bounds are sorted together over range partitions, totals of earlier partitions are added, and no pair of rows is ever formed. Bounds
on two columns are counted by dominance: within a range partition of the first column over blocks of doubling size, and
across partitions as running totals over the second column for each such block of partitions. `<>` is all less the equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.cells import DIV0
from quillgrid.operators.positions import kept

_LOOKS_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_MEASURES = ("rows", "total", "numbers")


@dataclass(frozen=True)
class By:
    """`column` of the table compared by `op` with `cell`, a column of the rows: "<=" is the criterion "<="&cell. With op ""
    the cell holds the whole criterion, such as "north", 5 or ">=10"; an empty cell is 0 then."""

    column: str
    op: str
    cell: str


def _kind(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType.typeName()
    if kind in ("string", "varchar", "char"):
        return "text"
    return {"boolean": "bool", "date": "time", "timestamp": "time", "timestamp_ntz": "time"}.get(kind, "num")


def _number(c: Column, kind: str) -> Column:
    """The number in a cell, NULL if it holds none: text that looks like one counts, times are microseconds."""
    if kind == "num":
        return c.cast("double") + F.lit(0.0)  # -0 is 0
    if kind == "text":
        return F.when(F.trim(c).rlike(_LOOKS_NUMBER), F.trim(c).try_cast("double") + F.lit(0.0))
    if kind == "time":
        whole = F.unix_date(c.cast("date")).cast("double") * 86_400_000_000
        return whole + (F.hour(c) * 3600 + F.minute(c) * 60).cast("double") * 1e6 + F.round(F.extract(F.lit("SECOND"), c).cast("double") * 1e6)
    return F.lit(None).cast("double")


def _key(c: Column, kind: str) -> Column:
    """What equal cells have in common: blanks, a number, or text without case."""
    if kind == "bool":
        return F.when(c.isNull(), "e").otherwise(F.concat(F.lit("b"), c.cast("string")))
    n = _number(c, kind)
    numeric = F.concat(F.lit("n"), n.cast("string"))
    if kind != "text":
        return F.when(c.isNull(), "e").otherwise(numeric)
    return F.when(c.isNull() | (c == ""), "e").when(n.isNotNull(), numeric).otherwise(F.concat(F.lit("t"), F.lower(c)))


def _asked_key(cell: Column, kind: str, table_kind: str) -> Column:
    """_key of a row's cell, for a table column of that kind."""
    if table_kind == "bool" and kind == "text":
        said = F.lower(cell)
        return F.when(cell.isNull() | (cell == ""), "e").when(said.isin("true", "false"), F.concat(F.lit("b"), said))
    if (table_kind == "bool") != (kind == "bool") or (table_kind == "time") != (kind == "time"):
        return F.when(cell.isNull(), "e")
    return _key(cell, kind)


def _order(c: Column, kind: str) -> Column:
    """What a bound compares: a number among numbers, text (without case) among texts."""
    text = F.upper(c) if kind == "text" else F.lit(None).cast("string")
    return F.struct(_number(c, kind).alias("num"), text.alias("txt"))


def _running(points: DataFrame, asks: DataFrame, strict: bool, falling: bool) -> DataFrame:
    """points (g, v, measures), asks (g, v), each once -> (g, v, measures): of each ask the sums over its g up to v, without
    v itself if strict; falling goes down from the largest.

    Both are sorted over range partitions by (g, v); a window runs within each (partition, g), which is a part of one
    partition, and a g that goes on from earlier partitions gets their totals: of those there are two a partition at most.
    """
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = [F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("numbers")]
    turn = (lambda side: -side) if strict else (lambda side: side)
    both = points.select("g", "v", *_MEASURES, F.lit(turn(0)).alias("turn")).unionByName(asks.select("g", "v", *nothing, F.lit(turn(1)).alias("turn")))
    order = [F.desc("v") if falling else F.asc("v"), F.asc("turn")]
    placed = kept(both.repartitionByRange(parts, F.asc("g"), *order).withColumn("part", F.spark_partition_id()), "bounds")
    inside = Window.partitionBy("part", "g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    so_far = placed.select("part", "g", "v", "turn", *[F.sum(m).over(inside).alias(m) for m in _MEASURES]).where(F.col("turn") == turn(1))
    by_part = placed.groupBy("g", "part").agg(*[F.sum(m).alias(m) for m in _MEASURES])
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("g", "part", *[F.sum(m).over(earlier).alias(f"base_{m}") for m in _MEASURES]).where("base_rows IS NOT NULL")
    joined = so_far.join(F.broadcast(base), ["part", "g"], "left")
    return joined.select("g", "v", *[(F.col(m) + F.coalesce(f"base_{m}", F.lit(0))).alias(m) for m in _MEASURES])


def _within(batches: Iterator[pa.RecordBatch], strict: bool) -> Iterator[pa.RecordBatch]:
    """One range partition, sorted by (g, x): for each ask the sums over the points before it of its g with y up to its own.

    The rows before place i are, for each bit of i, one block of that many rows. In the order of (block, g, y) the points
    asked for are one stretch, whose ends a search finds and whose sums are a difference of running sums."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    ask = table.column("side").to_numpy() == 1
    y = table.column("y").to_numpy()
    group = table.column("g").combine_chunks()
    group = np.asarray(pc.rank(group, tiebreaker="dense"))
    pairs = np.lexsort((y, group))
    fresh = np.concatenate(([True], (y[pairs][1:] != y[pairs][:-1]) | (group[pairs][1:] != group[pairs][:-1])))
    rank = np.empty(len(y), dtype=np.int64)
    rank[pairs] = np.cumsum(fresh) - 1
    first = np.full(int(group.max()) + 1, len(y), dtype=np.int64)
    np.minimum.at(first, group, rank)
    places, points, asks = np.arange(len(y)), np.flatnonzero(~ask), np.flatnonzero(ask)
    measures = [table.column(m).to_numpy() for m in _MEASURES]
    found = [np.zeros(len(y), dtype=m.dtype) for m in measures]
    width = int(rank.max()) + 1
    for level in range(len(y).bit_length()):
        mine = asks[(asks >> level) & 1 == 1]
        if not len(mine):
            continue
        key = (places[points] >> level) * width + rank[points]
        by = np.argsort(key, kind="stable")
        key = key[by]
        block = ((mine >> level) - 1) * width
        low = np.searchsorted(key, block + first[group[mine]], side="left")
        high = np.searchsorted(key, block + rank[mine], side="left" if strict else "right")
        for out, m in zip(found, measures, strict=True):
            sums = np.concatenate((np.zeros(1, dtype=m.dtype), np.cumsum(m[points][by])))
            out[mine] += sums[high] - sums[low]
    columns = [table.column(c).combine_chunks() for c in ("g", "x", "y", "side", *_MEASURES)]
    columns += [pa.array(np.full(len(y), TaskContext.get().partitionId(), dtype=np.int32)), *(pa.array(f) for f in found)]
    names = ["g", "x", "y", "side", *_MEASURES, "part", *(f"near_{m}" for m in _MEASURES)]
    yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=10_000)


def _dominated(points: DataFrame, asks: DataFrame, strict: tuple[bool, bool]) -> DataFrame:
    """points (g, x, y, measures), asks (g, x, y), each once -> (g, x, y, measures): of each ask the sums over the points of
    its g with x and y up to its own (without equal ones where strict)."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nothing = [F.lit(0).cast("long").alias("rows"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("numbers")]
    # An ask stands before or behind all points of its x. Points of one x are parted by y, so they are no single task.
    turn = F.when(F.col("side") == 1, F.lit(-1 if strict[0] else 1)).otherwise(0)
    both = points.select("g", "x", "y", *_MEASURES, F.lit(0).alias("side")).unionByName(asks.select("g", "x", "y", *nothing, F.lit(1).alias("side")))
    key = F.to_json("g")
    order = [F.asc("g"), F.asc("x"), F.asc("turn"), F.asc("y")]
    sorted_ = both.withColumn("turn", turn).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kinds = "rows long, total double, numbers long"
    near = ", ".join(f"near_{x}" for x in kinds.split(", "))
    flat = sorted_.select(key.alias("g"), "x", "y", "side", *_MEASURES)
    placed = kept(flat.mapInArrow(partial(_within, strict=strict[1]), f"g string, x double, y double, side int, {kinds}, part int, {near}"), "dominance")
    # A g in several partitions: the blocks of whole partitions before an ask's, by the bits of its number.
    spans = placed.groupBy("g").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last")  # as many as partitions, at most
    levels = F.array(*[F.lit(k) for k in range(max(1, (parts - 1).bit_length()))])
    unit, behind = F.expr("shiftright(part, level)"), F.expr("shiftleft(shiftright(part, level), level)")
    spread = placed.join(F.broadcast(spans), "g").withColumn("level", F.explode(levels)).withColumn("unit", unit)
    block = lambda u: F.array("g", F.col("level").cast("string"), u.cast("string")).alias("g")
    value = F.struct(F.col("y").alias("num"), F.lit(None).cast("string").alias("txt")).alias("v")
    blocks = spread.where("side = 0 AND unit % 2 = 0").select(block(F.col("unit")), value, *_MEASURES).groupBy("g", "v").agg(*[F.sum(m).alias(m) for m in _MEASURES])
    wanted = spread.where((F.col("side") == 1) & (F.col("unit") % 2 == 1) & (behind > F.col("first"))).select(F.col("g").alias("own"), "x", "y", block(F.col("unit") - 1))
    summed = _running(blocks, wanted.select("g", value).distinct(), strict[1], False).select("g", F.col("v.num").alias("y"), *_MEASURES)
    far = wanted.join(summed, ["g", "y"]).select(F.col("own").alias("g"), "x", "y", *_MEASURES)
    own = placed.where("side = 1").select("g", "x", "y", *[F.col(f"near_{m}").alias(m) for m in _MEASURES])
    return own.unionByName(far).groupBy("g", "x", "y").agg(*[F.sum(m).alias(m) for m in _MEASURES])


def _at(v: Column) -> Column:
    """One value that never is NULL for a (num, txt)."""
    return F.concat(F.coalesce(v["num"].cast("string"), F.lit("")), F.lit("|"), F.coalesce(v["txt"], F.lit("")))


def _split(df: DataFrame, conditions: list[By]) -> list[tuple[DataFrame, list[tuple[str, str, Column, str]]]]:
    """[(rows, [(table column, operator, cell, kind of the cell)])]: rows whose cells hold whole criteria are parted by the
    operators that they have, of which one small job finds the combinations."""
    tests, marks = [], []
    for k, c in enumerate(conditions):
        cell, kind = F.col(f"`{c.cell}`"), _kind(df, c.cell)
        if c.op:
            tests.append((c.column, c.op, cell, kind))
        elif kind != "text":
            tests.append((c.column, "=", F.coalesce(cell, F.lit(0).cast(df.schema[c.cell].dataType)) if kind == "num" else cell, kind))
        else:
            told = F.coalesce(cell, F.lit("0"))
            op = F.regexp_extract(told, r"^(<>|<=|>=|=|<|>)?", 1)
            df = df.withColumn(f"criteria operator {k}", F.when(op == "", "=").otherwise(op)).withColumn(f"criteria body {k}", F.substring(told, F.length(op) + 1, F.lit(2**31 - 1)))
            tests.append((c.column, "", F.col(f"criteria body {k}"), kind))
            marks.append(k)
    if not marks:
        return [(df, tests)]
    out = []
    for found in df.select(*[F.col(f"criteria operator {k}") for k in marks]).distinct().collect():  # six to the number of conditions, at most
        ops = dict(zip(marks, found, strict=True))
        rows = df.where(reduce(lambda a, b: a & b, [F.col(f"criteria operator {k}") == o for k, o in ops.items()]))
        out.append((rows, [(c, ops.get(k, o), cell, kind) for k, (c, o, cell, kind) in enumerate(tests)]))
    return out or [(df, [(c, o or "=", cell, kind) for c, o, cell, kind in tests])]


def _terms(own: list[tuple[str, Column]]) -> tuple[list[tuple[int, Column, bool, bool]], Column]:
    """The bounds of one column -> [(sign, bound, strict, falling)], and whether there can be any row."""
    upper = [(o, v) for o, v in own if o[0] == "<"]
    lower = [(o, v) for o, v in own if o[0] == ">"]
    if len(upper) > 1 or len(lower) > 1:
        raise ValueError("a column can have one bound on each side")
    if not upper:
        return [(1, lower[0][1], lower[0][0] == ">", True)], F.lit(True)
    up = (1, upper[0][1], upper[0][0] == "<", False)
    if not lower:
        return [up], F.lit(True)
    a, b = lower[0][1], upper[0][1]
    some = F.when(a["num"].isNotNull() & b["num"].isNotNull(), a["num"] <= b["num"]).when(a["num"].isNull() & b["num"].isNull(), a["txt"] <= b["txt"])
    return [up, (-1, a, lower[0][0] == ">=", False)], F.coalesce(some, F.lit(False))


def _totals(df: DataFrame, table: DataFrame, tests: list, summed: str | None, to: tuple[str, ...]) -> DataFrame:
    """df with the measures of the table's rows that meet all tests."""
    kinds = {c.name: _kind(table, c.name) for c in table.schema}
    value = _summand(table, summed)
    rows = table.select("*", F.lit(1).cast("long").alias("rows"), F.coalesce(value, F.lit(0.0)).alias("total"), F.when(value.isNotNull(), 1).otherwise(0).cast("long").alias("numbers"))
    equal, unequal, bounds = [], [], {}
    for k, (column, op, cell, kind) in enumerate(tests):
        if op in ("=", "<>"):
            df = df.withColumn(f"criteria key {k}", _asked_key(cell, kind, kinds[column]))
            (equal if op == "=" else unequal).append((column, f"criteria key {k}"))
        else:
            if kinds[column] == "bool" or (kinds[column] == "time") != (kind == "time"):
                raise ValueError(f"{column!r} and its bound are not comparable")
            blank = (cell == "") if kind == "text" else F.lit(False)
            bound = F.when(cell.isNotNull() & ~blank, _order(cell, kind))
            df = df.withColumn(f"criteria bound {k}", bound)
            bounds.setdefault(column, []).append((op, F.col(f"criteria bound {k}")))
    if len(bounds) > 2 or len(bounds) == 2 and any(kinds[c] == "text" for c in bounds):
        raise ValueError("bounds of at most two columns, which hold numbers or times where there are two")
    by_column = {c: _terms(own) for c, own in bounds.items()}
    possible = reduce(lambda a, b: a & b, [p for _, p in by_column.values()], F.lit(True))
    parts = []
    for chosen in product((False, True), repeat=len(unequal)):
        keys = equal + [u for u, c in zip(unequal, chosen, strict=True) if c]
        for picked in product(*[t for t, _ in by_column.values()]):
            sign = (-1) ** sum(chosen) * int(np.prod([t[0] for t in picked]))
            name = f"criteria part {len(parts)}"
            df = _joined(df, rows, kinds, keys, list(zip(by_column, picked, strict=True)), name)
            parts.append((sign, name))
    for m, name in zip(_MEASURES, to, strict=True):
        whole = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{p}`.{m}"), F.lit(0)) * s for s, p in parts])
        df = df.withColumn(name, F.when(possible, whole).otherwise(0).cast("double" if m == "total" else "long"))
    return df


def _summand(table: DataFrame, summed: str | None) -> Column:
    """The numbers of the summed column: no text, and 1 and 0 for booleans."""
    if summed is None or _kind(table, summed) in ("text", "time"):
        return F.lit(None).cast("double")
    return F.col(f"`{summed}`").cast("double")


def _joined(df: DataFrame, rows: DataFrame, kinds: dict, keys: list, bounds: list, name: str) -> DataFrame:
    """df with the struct `name` of measures for equal keys and one combination of bounds."""
    cell = lambda c: F.col(f"`{c}`")
    g = [_key(cell(c), kinds[c]) for c, _ in keys]
    asked = [F.col(f"`{k}`") for _, k in keys]
    sums = [F.sum(m).alias(m) for m in _MEASURES]
    found = F.struct(*_MEASURES).alias(name)
    text = F.array().cast("array<string>")
    if not bounds:
        side = rows.select((F.array(*g) if g else text).alias("g"), *_MEASURES).groupBy("g").agg(*sums).select(F.col("g").alias("criteria g"), found)
        df = df.withColumn("criteria g", F.array(*asked) if asked else text)
        return df.join(side, "criteria g", "left").drop("criteria g")
    if len(bounds) == 1:
        (column, (_, bound, strict, falling)) = bounds[0]
        order = _order(cell(column), kinds[column])
        views = [F.struct(F.lit("n").alias("view"), F.struct(order["num"].alias("num"), F.lit(None).cast("string").alias("txt")).alias("v"))]
        if kinds[column] == "text":
            views.append(F.struct(F.lit("t").alias("view"), F.struct(F.lit(None).cast("double").alias("num"), order["txt"].alias("txt")).alias("v")))
        seen = rows.withColumn("seen", F.explode(F.array(*views))).where("(seen.v.num IS NOT NULL AND NOT isnan(seen.v.num)) OR seen.v.txt IS NOT NULL")
        points = seen.select(F.array(*g, F.col("seen.view")).alias("g"), F.col("seen.v").alias("v"), *_MEASURES).groupBy("g", "v").agg(*sums)
        view = F.when(bound["num"].isNotNull(), "n").otherwise("t")
        told = F.when(bound.isNotNull(), F.struct(bound["num"].alias("num"), F.when(bound["num"].isNull(), bound["txt"]).alias("txt")))
        df = df.withColumn("criteria v", told).withColumn("criteria g", F.array(*asked, view)).withColumn("criteria at", F.when(F.col("criteria v").isNotNull(), _at(F.col("criteria v"))))
        asks = df.where("`criteria at` IS NOT NULL").select(F.col("criteria g").alias("g"), F.col("criteria v").alias("v")).distinct()
        side = _running(points, asks, strict, falling).select(F.col("g").alias("criteria g"), _at(F.col("v")).alias("criteria at"), found)
        return df.join(side, ["criteria g", "criteria at"], "left").drop("criteria g", "criteria at", "criteria v")
    (first, (_, bound_x, strict_x, falling_x)), (second, (_, bound_y, strict_y, falling_y)) = bounds
    signed = lambda c, falling: (-c if falling else c) + F.lit(0.0)
    x, y = signed(_number(cell(first), kinds[first]), falling_x), signed(_number(cell(second), kinds[second]), falling_y)
    points = rows.select((F.array(*g) if g else text).alias("g"), x.alias("x"), y.alias("y"), *_MEASURES).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    points = points.groupBy("g", "x", "y").agg(*sums)
    df = df.withColumn("criteria x", signed(bound_x["num"], falling_x)).withColumn("criteria y", signed(bound_y["num"], falling_y)).withColumn("criteria g", F.array(*asked) if asked else text)
    asks = df.where("`criteria x` IS NOT NULL AND `criteria y` IS NOT NULL").select(F.col("criteria g").alias("g"), F.col("criteria x").alias("x"), F.col("criteria y").alias("y")).distinct()
    side = _dominated(points, asks, (strict_x, strict_y)).select(F.col("g").alias("criteria j"), F.col("x").alias("criteria x"), F.col("y").alias("criteria y"), found)
    joined = df.withColumn("criteria j", F.to_json("criteria g")).join(side, ["criteria j", "criteria x", "criteria y"], "left")
    return joined.drop("criteria g", "criteria j", "criteria x", "criteria y")


def _measured(df: DataFrame, table: DataFrame, conditions: tuple[By, ...], summed: str | None) -> DataFrame:
    to = tuple(f"criteria {m}" for m in _MEASURES)
    each = [_totals(rows, table, tests, summed, to).select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{c}`") for c in to]) for rows, tests in _split(df, list(conditions))]
    return reduce(DataFrame.unionAll, each)


def COUNTIFS(df: DataFrame, table: DataFrame, *conditions: By, name: str = "count") -> DataFrame:
    """df with the number of the table's rows that meet all of the row's conditions.

    Numbers are compared with numbers, cells of text that hold one included, and text with text without case (* and ? are
    no wildcards here); an empty cell equals blanks and is no bound; NaN meets no bound. At most two columns can have bounds,
    one on each side of each.
    """
    kept_ = [F.col(f"`{c}`") for c in df.columns]
    return _measured(df, table, conditions, None).select(*kept_, F.col("`criteria rows`").alias(name))


def SUMIFS(df: DataFrame, table: DataFrame, summed: str, *conditions: By, name: str = "sum") -> DataFrame:
    """df with the sum of the table's numbers in `summed` whose rows meet the conditions, as for COUNTIFS; 0 if none do. A
    sum is one of running totals, so its rounding is that of the total it is taken from."""
    kept_ = [F.col(f"`{c}`") for c in df.columns]
    return _measured(df, table, conditions, summed).select(*kept_, F.col("`criteria total`").alias(name))


def AVERAGEIFS(df: DataFrame, table: DataFrame, averaged: str, *conditions: By, name: str = "average") -> DataFrame:
    """df with the mean of those numbers and `name`_error, #DIV/0! where there is none."""
    kept_ = [F.col(f"`{c}`") for c in df.columns]
    n = F.col("`criteria numbers`")
    return _measured(df, table, conditions, averaged).select(*kept_, F.when(n > 0, F.col("`criteria total`") / F.when(n > 0, n)).alias(name), F.when(n == 0, F.lit(DIV0)).alias(f"{name}_error"))
