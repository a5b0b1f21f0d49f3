"""Lookups as joins: exact (first match wins) and approximate (as-of, backward or forward).

Approximate lookups take the table as sorted by its key, which is what makes their answer well defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.cells import NA
from quillgrid.operators.positions import kept, numbered

#: Rows of an approximate table that are kept as one sorted array in every task; larger ones are merged by a window.
ARRAY_ROWS = 50_000
#: Rows (of two columns) that one task numbers at most.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame, limit: int) -> bool:
    return df.limit(limit + 1).count() <= limit


def _own(df: DataFrame, name: str) -> Column:
    """A column of df by name, dots in it included."""
    return df[f"`{name}`"]


def vlookup_exact(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str | None = None, name: str = "found") -> DataFrame:
    """df with `name` (NULL if there is none) and `name`_error (#N/A then): the value of the first row of table, by
    `order` (without one, the smallest value), whose key is equal. Text keys compare without case. The table comes down to
    a row a key; whether that is broadcast is left to Spark, which knows its size in bytes."""
    text = dict(table.dtypes)[table_key] == "string"
    fold = F.upper if text else (lambda c: c)
    row = F.struct(_own(table, value).alias("v"))
    unique = table.where(_own(table, table_key).isNotNull()).groupBy(fold(_own(table, table_key)).alias("lookup key")).agg((F.min_by(row, _own(table, order)) if order else F.min(row)).alias("lookup row"))
    joined = df.join(unique, fold(_own(df, key)) == unique["lookup key"], "left")
    return joined.select(*[_own(df, c) for c in df.columns], F.col("lookup row.v").alias(name), F.when(F.col("lookup row").isNull(), F.lit(NA)).alias(f"{name}_error"))


def lookup_approximate(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, forward: bool = False, name: str = "found") -> DataFrame:
    """df with `name` and `name`_error: the value at the largest table key that is not above the row's key (with
    forward, the smallest that is not below); #N/A if there is none. Of equal keys the smallest value counts.

    A small table becomes one sorted array that each row searches by halving; a large one is merged with the rows by a
    window over ranges of the key.
    """
    sign = -1.0 if forward else 1.0
    points = table.where(_own(table, table_key).isNotNull()).groupBy((_own(table, table_key).cast("double") * sign).alias("k")).agg(F.min(F.struct(_own(table, value).alias("v"))).alias("v"))
    asked = df.withColumn("lookup key", _own(df, key).cast("double") * sign)
    if _small(points, ARRAY_ROWS):
        one = points.agg(F.sort_array(F.collect_list(F.struct("k", "v"))).alias("points"))
        steps = [1 << i for i in reversed(range(ARRAY_ROWS.bit_length()))]
        n = F.size("points")
        at = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda low, s: F.when((low + s <= n) & F.coalesce(F.try_element_at("points", low + s)["k"] <= F.col("lookup key"), F.lit(False)), low + s).otherwise(low),
        )
        found = asked.join(F.broadcast(one)).withColumn("hit", F.when(F.col("lookup key").isNotNull(), F.get("points", at - 1)))
        return found.select(*[_own(df, c) for c in df.columns], F.col("hit.v.v").alias(name), F.when(F.col("hit").isNull(), F.lit(NA)).alias(f"{name}_error"))
    return _merged(df, asked, points, name)


def _merged(df: DataFrame, asked: DataFrame, points: DataFrame, name: str) -> DataFrame:
    """Rows and points in one table, cut into key ranges at quantiles of the points; each range begins with the last
    point before it, so ranges are independent and no window spans the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(points.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], min(10 * parts, 10_000))).first()[0]))
    bounds = F.split(F.lit(",".join(map(repr, map(float, cuts)))), ",").cast("array<double>")
    steps = [1 << i for i in reversed(range(max(1, len(cuts)).bit_length()))]

    def part(k):
        return F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda low, s: F.when((low + s <= len(cuts)) & F.coalesce(F.try_element_at(bounds, low + s) <= k, F.lit(False)), low + s).otherwise(low),
        )

    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    none = F.lit(None).cast(asked.select(whole.alias("r")).schema["r"].dataType)
    left = asked.select(F.col("lookup key").alias("k"), whole.alias("r"), F.lit(None).cast(points.schema["v"].dataType).alias("v"), F.lit(1).alias("side")).withColumn("part", part(F.col("k")))
    right = points.select("k", none.alias("r"), "v", F.lit(0).alias("side")).withColumn("part", part(F.col("k")))
    # A cut is itself a point, so a range's rows find theirs inside it; only the rows under the first cut may find none.
    # Rows are dealt to salts within a range, each with all of the range's points, so rows of one key are no one task.
    window = Window.partitionBy("part", "salt").orderBy(F.col("k").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, 0)
    seen = _salted(left, right).withColumn("hit", F.last("v", ignorenulls=True).over(window)).where("side = 1")
    hit = F.when(F.col("k").isNotNull(), F.col("hit"))
    return seen.select(*[F.col(f"r.`{c}`").alias(c) for c in df.columns], hit["v"].alias(name), F.when(hit.isNull(), F.lit(NA)).alias(f"{name}_error"))


#: Salts of each range of a large approximate lookup.
SALTS = 16


def _salted(left: DataFrame, right: DataFrame) -> DataFrame:
    dealt = left.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copied = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.unionByName(copied)


def match(df: DataFrame, key: str, table: DataFrame, table_key: str, order: str, kind: int = 0, name: str = "position") -> DataFrame:
    """df with the 1-based position in table (by `order`) of the key: 0 the first equal one, 1 the largest not above,
    -1 the smallest not below. Positions are made for the table's distinct keys."""
    numbered = table.select(_own(table, table_key).alias("mk"), _own(table, order).alias("mo"))
    ranked = numbered.withColumn("mp", F.row_number().over(Window.orderBy("mo"))) if _small(numbered, BROADCAST_ROWS) else _positions(numbered)
    if kind == 0:
        return vlookup_exact(df, key, ranked, "mk", "mp", "mo", name)
    return lookup_approximate(df, key, ranked, "mk", "mp", forward=kind < 0, name=name)


def _positions(rows: DataFrame) -> DataFrame:
    """Row numbers by `mo`, as `mp`."""
    return numbered(rows, [F.asc("mo")], "mp")


def index(df: DataFrame, position: str, table: DataFrame, order: str, value: str, name: str = "found") -> DataFrame:
    """df with the value at a 1-based position of table (by `order`): #REF! beyond it, #VALUE! under 1."""
    numbered = table.select(_own(table, value).alias("mk"), _own(table, order).alias("mo"))
    ranked = numbered.withColumn("mp", F.row_number().over(Window.orderBy("mo"))) if _small(numbered, BROADCAST_ROWS) else _positions(numbered)
    joined = df.join(ranked, _own(df, position) == ranked["mp"], "left")
    failed = F.when(_own(df, position) < 1, F.lit("#VALUE!")).when(F.col("mp").isNull(), F.lit("#REF!"))
    return joined.select(*[_own(df, c) for c in df.columns], F.col("mk").alias(name), failed.alias(f"{name}_error"))


def _reigns(table: DataFrame, table_key: str, value: str, order: str, falling: bool) -> tuple[DataFrame, DataFrame]:
    """For a scan of the table by `order` that stops at the first greater key: (m, end) of each key m that is greater than
    all before it, with the row at which a scan for anything from m up to the next such key ends, and (k, hit) of the
    first row of each key. Both rows are (pos, v); `end` has the position of the stop as well.

    The table is sorted once over range partitions. Running maxima, the row before and the next maximum are windows within
    a partition; what comes from other partitions is one row for each of them.
    """
    sign = -1.0 if falling else 1.0
    rows = table.select((_own(table, table_key).try_cast("double") * sign).alias("k"), _own(table, value).alias("v"), _own(table, order).alias("o"))
    rows = kept(rows.orderBy("o").select("k", "v", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "scan")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.max("k").alias("most"), F.max_by(F.struct("at", "v"), F.when(F.col("k").isNotNull(), F.col("at"))).alias("last"))
    first = parts.select("part", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("base"), F.max("most").over(whole).alias("base_most"), "last")
    place = (F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("pos")
    first = kept(first.withColumn("own_last", F.struct((F.col("base") + F.col("last.at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("pos"), F.col("last.v").alias("v"))).withColumn("own_last", F.when(F.col("last").isNotNull(), F.col("own_last"))), "scan-parts")
    bases = first.select("part", "base", "base_most", F.last("own_last", ignorenulls=True).over(whole).alias("base_last"))
    within = Window.partitionBy("part").orderBy("at")
    live = rows.join(F.broadcast(bases), "part").where("k IS NOT NULL").select("part", "at", "k", "v", place, "base_most", "base_last")
    seen = F.max("k").over(within.rowsBetween(Window.unboundedPreceding, -1))
    told = live.select("part", "at", "k", "pos", F.greatest(seen, "base_most").alias("seen"), F.coalesce(F.lag(F.struct("pos", "v")).over(within), F.col("base_last")).alias("before"))
    records = kept(told.where(F.col("seen").isNull() | (F.col("k") > F.col("seen"))).select("part", "at", "k", "pos", "before"), "maxima")
    starts = records.groupBy("part").agg(F.min_by(F.struct("pos", "before"), "at").alias("start"))
    later = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    follows = rows.select("part").distinct().join(starts, "part", "left").select("part", F.last("start", ignorenulls=True).over(later).alias("follows"))
    last = first.agg(F.max(F.struct(F.col("own_last.pos").alias("pos"), "own_last")).alias("x")).select(F.col("x.own_last").alias("very_last"))
    nexts = records.join(F.broadcast(follows), "part").withColumn("next", F.coalesce(F.lead(F.struct("pos", "before")).over(within), F.col("follows"))).join(F.broadcast(last))
    end = F.struct(F.coalesce("next.pos", F.lit(1 << 60)).alias("stop"), F.coalesce("next.before", "very_last").alias("row"))
    return nexts.select(F.col("k").alias("m"), end.alias("end")), live.groupBy("k").agg(F.min(F.struct("pos", "v")).alias("hit"))


def _scanned(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str, falling: bool) -> DataFrame:
    """df with the (pos, v) at which the scan ends, as `scan row`."""
    ends, firsts = _reigns(table, table_key, value, order, falling)
    asked = df.withColumn("scan key", _own(df, key).try_cast("double") * (-1.0 if falling else 1.0))
    at_end = lookup_approximate(asked, "scan key", kept(ends, "ends"), "m", "end", name="scan end").drop("scan end_error")
    equal = vlookup_exact(at_end, "scan key", firsts, "k", "hit", name="scan hit").drop("scan hit_error")
    row = F.when(F.col("scan hit.pos") < F.col("scan end.stop"), F.col("scan hit")).otherwise(F.col("scan end.row"))
    return equal.withColumn("scan row", row).drop("scan key", "scan end", "scan hit")


def vlookup_scan(df: DataFrame, key: str, table: DataFrame, table_key: str, value: str, order: str, name: str = "found", falling: bool = False) -> DataFrame:
    """df with `name` and `name`_error: the approximate VLOOKUP over a table that need not be sorted, read by `order` from
    its first row on: the first equal key before any greater one, else the last row before the first greater key; #N/A if
    the first key is greater already, or the row's key is blank. falling: smaller for greater. Keys are numbers; other
    cells are passed over. On sorted keys it is lookup_approximate."""
    found = _scanned(df, key, table, table_key, value, order, falling)
    return found.select(*[_own(found, c) for c in df.columns], F.col("scan row.v").alias(name), F.when(F.col("scan row").isNull(), F.lit(NA)).alias(f"{name}_error"))


def match_scan(df: DataFrame, key: str, table: DataFrame, table_key: str, order: str, kind: int = 1, name: str = "position") -> DataFrame:
    """df with the position (from 1, blank cells counted) that MATCH with type 1 or -1 finds in a table in any order."""
    found = _scanned(df, key, table, table_key, order, order, kind < 0)
    return found.select(*[_own(found, c) for c in df.columns], F.col("scan row.pos").alias(name), F.when(F.col("scan row").isNull(), F.lit(NA)).alias(f"{name}_error"))


def hlookup(df: DataFrame, key: str, table: DataFrame, row: int, order: str, name: str = "found", approximate: bool = False) -> DataFrame:
    """The cell of row `row` (1 is the header) of the first column whose header equals the key; with approximate, of the
    largest numeric header that is not above the key. The row is unpivoted: as many rows as the table has columns."""
    columns = [c for c in table.columns if c != order]
    picked = table.orderBy(order).limit(row - 1).orderBy(F.desc(order)).limit(1) if row > 1 else None
    if picked is None:
        headers = table.sparkSession.createDataFrame([(i, c, c) for i, c in enumerate(columns)], "place int, header string, cell string")
    else:
        cells = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("header"), F.col(c).cast("string").alias("cell")) for i, c in enumerate(columns)]
        headers = picked.select(F.explode(F.array(*cells)).alias("h")).select("h.*")
    if approximate:
        return lookup_approximate(df, key, headers.withColumn("header", F.col("header").try_cast("double")), "header", "cell", name=name)
    return vlookup_exact(df, key, headers, "header", "cell", "place", name)
