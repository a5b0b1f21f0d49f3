"""Sheets as cell tables, and the operations that move, sort, find and replace cells.

A cell table has one row for each cell that is not blank: sheet, row, col (both from 1), kind (n, s, b, e), num, txt,
bool, err and formula.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.operators.rebase import columns_shifted, copied, rows_shifted

COLUMNS = ["sheet", "row", "col", "kind", "num", "txt", "bool", "err", "formula"]


def to_cells(df: DataFrame, row: str, sheet: str = "Sheet1", columns: list[str] | None = None, header: bool = False) -> DataFrame:
    """The cells of a table: `row` names its row number (from 1; with header, the headers are row 1 and rows shift)."""
    columns = columns or [c for c in df.columns if c != row]
    kinds = dict(df.dtypes)
    none = {"num": "double", "txt": "string", "bool": "boolean"}

    def one(i: int, name: str) -> Column:
        kind = kinds[name]
        part = "txt" if kind == "string" else "bool" if kind == "boolean" else "txt" if kind.startswith(("date", "timestamp")) else "num"
        values = [(F.col(name).cast(t) if p == part else F.lit(None).cast(t)).alias(p) for p, t in none.items()]
        return F.struct(F.lit(i).alias("col"), F.lit({"num": "n", "txt": "s", "bool": "b"}[part]).alias("kind"), *values)

    cells = df.select(F.col(row).cast("long").alias("row"), F.explode(F.array(*[one(i, c) for i, c in enumerate(columns, 1)])).alias("c"))
    flat = cells.select(F.lit(sheet).alias("sheet"), (F.col("row") + int(header)).alias("row"), "c.col", "c.kind", "c.num", "c.txt", "c.bool", F.lit(None).cast("string").alias("err"), F.lit(None).cast("string").alias("formula"))
    flat = flat.where(F.coalesce(F.col("num").cast("string"), F.col("txt"), F.col("bool").cast("string")).isNotNull())
    if not header:
        return flat
    titles = df.sparkSession.createDataFrame([(sheet, 1, i, "s", None, c, None, None, None) for i, c in enumerate(columns, 1)], flat.schema)
    return flat.unionByName(titles)


def from_cells(cells: DataFrame, names: dict[int, str], row: str = "row") -> DataFrame:
    """A wide table of text from cells: column number -> name. One grouped pass."""
    shown = display(cells)
    return cells.groupBy(F.col("row").alias(row)).agg(*[F.first(F.when(F.col("col") == i, shown), ignorenulls=True).alias(n) for i, n in names.items()])


def display(cells: DataFrame | None = None) -> Column:
    """The shown text of a cell."""
    n = F.col("num")
    whole = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), n.cast("bigint").cast("string")).otherwise(n.cast("string"))
    return F.coalesce(F.col("err"), F.col("txt"), F.when(F.col("bool"), "TRUE").when(~F.col("bool"), "FALSE"), whole)


def read_range(cells: DataFrame, first_row: int, first_col: int, last_row: int, last_col: int, sheet: str | None = None) -> DataFrame:
    """The cells of a range in row-major order."""
    low, high = sorted((first_row, last_row)), sorted((first_col, last_col))
    inside = F.col("row").between(*low) & F.col("col").between(*high)
    if sheet is not None:
        inside = inside & (F.col("sheet") == sheet)
    return cells.where(inside).orderBy("sheet", "row", "col")


def sort_rows(df: DataFrame, key: str, order: str, ascending: bool = True) -> DataFrame:
    """Stable sort by one key: blanks first (last if descending); ties keep their order by `order`. Text compares with
    case."""
    return df.orderBy(F.col(key).asc_nulls_first() if ascending else F.col(key).desc_nulls_last(), order)


def sort_key(kind: Column, num: Column, bool_: Column, txt: Column) -> list[Column]:
    """Sort columns for cells of mixed kinds: blank < number < boolean < text < error."""
    rank = F.when(kind.isNull(), 0).when(kind == "n", 1).when(kind == "b", 2).when(kind == "s", 3).otherwise(5)
    return [rank, num, bool_, txt]


def insert_rows(cells: DataFrame, at: int, n: int) -> DataFrame:
    """Cells from row `at` on move down, and references in formulas follow them."""
    moved = cells.withColumn("row", F.when(F.col("row") >= at, F.col("row") + n).otherwise(F.col("row")))
    return moved.withColumn("formula", rows_shifted(F.col("formula"), at, n))


def delete_rows(cells: DataFrame, at: int, n: int) -> DataFrame:
    left = cells.where((F.col("row") < at) | (F.col("row") >= at + n))
    moved = left.withColumn("row", F.when(F.col("row") >= at, F.col("row") - n).otherwise(F.col("row")))
    return moved.withColumn("formula", rows_shifted(F.col("formula"), at, -n))


def insert_columns(cells: DataFrame, at: int, n: int) -> DataFrame:
    moved = cells.withColumn("col", F.when(F.col("col") >= at, F.col("col") + n).otherwise(F.col("col")))
    return moved.withColumn("formula", columns_shifted(F.col("formula"), at, n))


def delete_columns(cells: DataFrame, at: int, n: int) -> DataFrame:
    left = cells.where((F.col("col") < at) | (F.col("col") >= at + n))
    moved = left.withColumn("col", F.when(F.col("col") >= at, F.col("col") - n).otherwise(F.col("col")))
    return moved.withColumn("formula", columns_shifted(F.col("formula"), at, -n))


def clear_range(cells: DataFrame, first_row: int, first_col: int, last_row: int, last_col: int) -> DataFrame:
    return cells.where(~(F.col("row").between(first_row, last_row) & F.col("col").between(first_col, last_col)))


def upsert(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """cells with those of changes put in their places: a full outer join by sheet, row and col."""
    keys = ["sheet", "row", "col"]
    rest = [c for c in cells.columns if c not in keys]
    old = cells.select(*keys, F.struct(*rest).alias("old"))
    new = changes.select(*keys, F.struct(*[F.col(c) for c in rest]).alias("new"))
    return old.join(new, keys, "full_outer").select(*keys, F.coalesce("new", "old").alias("cell")).select(*keys, "cell.*")


def copy_range(cells: DataFrame, first_row: int, first_col: int, last_row: int, last_col: int, to_row: int, to_col: int, move: bool = False) -> DataFrame:
    """cells with a range also (or, moved, only) at another place. Overlaps read the old cells; relative references in
    formulas move along."""
    inside = F.col("row").between(first_row, last_row) & F.col("col").between(first_col, last_col)
    down, right = to_row - first_row, to_col - first_col
    shifted = cells.where(inside).withColumns({"row": F.col("row") + down, "col": F.col("col") + right, "formula": copied(F.col("formula"), down, right)})
    return upsert(cells.where(~inside) if move else cells, shifted)


def transpose(cells: DataFrame) -> DataFrame:
    return cells.withColumns({"row": F.col("col").cast("long"), "col": F.col("row").cast("int")})


def find_cells(cells: DataFrame, part: str) -> DataFrame:
    """Cells whose shown text contains part, with case."""
    return cells.where(display().contains(part))


def find_cells_by_value(cells: DataFrame, value) -> DataFrame:
    """Cells that hold just this number, text or boolean."""
    c = F.col("bool") if isinstance(value, bool) else F.col("num") if isinstance(value, (int, float)) else F.col("txt")
    return cells.where(c == F.lit(value))


def set_values_2d(cells: DataFrame, values: DataFrame, row: str, at_row: int, at_col: int, sheet: str = "Sheet1") -> DataFrame:
    """cells with a table's values (its rows numbered by `row` from 1) put in from a corner on; blanks of the table clear
    what they meet."""
    columns = [c for c in values.columns if c != row]
    place = {"row": F.col("row") + at_row - 1, "col": (F.col("col") + at_col - 1).cast("int")}
    new = to_cells(values, row, sheet).withColumns(place)
    covered = values.select(F.lit(sheet).alias("sheet"), F.col(row).cast("long").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(len(columns)))).alias("col")).withColumns(place)
    return upsert(cells.join(covered, ["sheet", "row", "col"], "left_anti"), new)


def replace_text(cells: DataFrame, old: str, new: str) -> DataFrame:
    """Text cells with every occurrence replaced; formulas and numbers stay."""
    return cells.withColumn("txt", F.when(F.col("formula").isNull(), F.replace("txt", F.lit(old), F.lit(new))).otherwise(F.col("txt")))


def count_replacements(cells: DataFrame, old: str) -> Column:
    return F.when(F.col("txt").isNotNull(), (F.length("txt") - F.length(F.replace("txt", F.lit(old), F.lit("")))) / len(old)).otherwise(0)


def typed(text: Column) -> list[Column]:
    """kind, num, txt, bool of text as typed into a cell: a number, TRUE or FALSE, else text."""
    n = F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text).try_cast("double"))
    b = F.when(F.upper(text) == "TRUE", True).when(F.upper(text) == "FALSE", False)
    kind = F.when(n.isNotNull(), "n").when(b.isNotNull(), "b").otherwise("s")
    return [kind.alias("kind"), n.alias("num"), F.when(n.isNull() & b.isNull(), text).alias("txt"), F.when(n.isNull(), b).alias("bool")]


def points(cells: DataFrame, first_row: int, first_col: int, last_row: int, last_col: int, sheet: str | None = None) -> DataFrame:
    """(row, col, number, label) of the cells of a range, as a chart or sparkline reads it: numbers (booleans 1 and 0,
    NULL for text and errors) and shown texts, in row-major order."""
    number = F.coalesce(F.col("num"), F.col("bool").cast("double"))
    return read_range(cells, first_row, first_col, last_row, last_col, sheet).select("row", "col", number.alias("number"), display().alias("label"))


def share_of_category(df: DataFrame, category: list[str], value: str, name: str = "share") -> DataFrame:
    """df with each value's share of the sum of its category, as stacked charts of 100 % show it; NULL if the sum is 0."""
    sums = df.groupBy(*[F.col(c).alias(f"share {i}") for i, c in enumerate(category)]).agg(F.sum(F.col(value).cast("double")).alias("share sum"))
    same = [F.col(c).eqNullSafe(F.col(f"share {i}")) for i, c in enumerate(category)]
    joined = df.join(sums, same)
    return joined.withColumn(name, F.when(F.col("share sum") != 0, F.col(value) / F.col("share sum"))).drop("share sum", *[f"share {i}" for i in range(len(category))])


def cache_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with `record`: its fields as a pivot cache keeps them, (kind, value): n numbers, s texts, b booleans, m blanks."""
    kinds = dict(df.dtypes)

    def field(name: str) -> Column:
        kind = "s" if kinds[name] in ("string", "date") or kinds[name].startswith("timestamp") else "b" if kinds[name] == "boolean" else "n"
        return F.struct(F.when(F.col(name).isNull(), "m").otherwise(kind).alias("kind"), F.col(name).cast("string").alias("value"))

    return df.withColumn("record", F.array(*map(field, columns)))


def info(cells: DataFrame) -> DataFrame:
    """(sheet, cells, formulas, rows, columns) of each sheet."""
    return cells.groupBy("sheet").agg(F.count("*").alias("cells"), F.count("formula").alias("formulas"), F.max("row").alias("rows"), F.max("col").alias("columns"))


#: Cells of a grid at most.
GRID = 10_000_000


def finance_grid(spark, dimensions: dict[str, list[str] | DataFrame], scenarios: list[str] | None = None) -> DataFrame:
    """Every combination of dimension members and scenarios; empty dimensions read n/a, no scenario base. A dimension is a
    list, or a DataFrame of one column whose different values are its members. A grid of more than GRID cells is refused."""
    out, cells = spark.createDataFrame([(s,) for s in scenarios or ["base"]], "scenario string"), len(scenarios or ["base"])
    for name, members in dimensions.items():
        if isinstance(members, DataFrame):
            known = members.select(F.col(f"`{members.columns[0]}`").cast("string").alias(name)).distinct()
            n = known.limit(GRID + 1).count()
            own = known if n else spark.createDataFrame([("n/a",)], f"`{name}` string")
        else:
            n, own = len(members), spark.createDataFrame([(m,) for m in members or ["n/a"]], f"`{name}` string")
        cells *= max(1, n)
        if cells > GRID:
            raise ValueError(f"the grid has more than {GRID} cells")
        out = out.crossJoin(own)
    return out
