"""Queries over lookups, pivots, filters, conditional formats, reshaping, text form and checks, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from quillgrid.functions import dates as DT
from quillgrid.functions.cells import num
from quillgrid.operators import aggregates as A
from quillgrid.operators import filters as FL
from quillgrid.operators import lookup as L
from quillgrid.operators import pivot as P
from quillgrid.operators.positions import numbered
from quillgrid.operators import reshape as R
from quillgrid.operators import textform as T
from quillgrid.plans.ranges import r, table
from quillgrid.streaming import rowwise

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT c_custkey, n_name AS nation, CASE WHEN n_name IS NULL THEN '#N/A' END AS nation_error
    FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON c_nationkey = n_nationkey""")
def vlookup_exact(spark, sf_dir):
    """VLOOKUP with an exact match; nations from 20 on are left out and give #N/A."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return L.vlookup_exact(table(spark, sf_dir, "customer"), "c_nationkey", nations, "n_nationkey", "n_name", "n_nationkey", "nation").select("c_custkey", "nation", "nation_error")


@query("""SELECT s_suppkey, p_partkey AS first_part FROM supplier LEFT JOIN (SELECT p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_size) ON s_nationkey = p_size""")
def vlookup_first_match(spark, sf_dir):
    """VLOOKUP where keys repeat: the first row by its order counts."""
    found = L.vlookup_exact(table(spark, sf_dir, "supplier"), "s_nationkey", table(spark, sf_dir, "part"), "p_size", "p_partkey", "p_partkey", "first_part")
    return found.select("s_suppkey", "first_part")


_BANDS = [(0.0, "small"), (50000.0, "medium"), (200000.0, "large")]
_BANDS_SQL = "(VALUES (0.0, 'small'), (50000.0, 'medium'), (200000.0, 'large')) b(low, band)"


@query(f"SELECT band, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders ASOF LEFT JOIN {_BANDS_SQL} ON o_totalprice >= low GROUP BY band")
def vlookup_approx(spark, sf_dir):
    """VLOOKUP with an approximate match: orders by price band."""
    bands = spark.createDataFrame(_BANDS, "low double, band string")
    found = L.lookup_approximate(table(spark, sf_dir, "orders"), "o_totalprice", bands, "low", "band", name="band")
    return found.groupBy("band").agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH p AS (SELECT p_retailprice AS k, min(p_partkey) AS v FROM part GROUP BY 1)
    SELECT c_custkey, v AS part FROM customer ASOF LEFT JOIN p ON c_acctbal >= k""")
def lookup_vector(spark, sf_dir):
    """LOOKUP of account balances in the sorted prices of parts."""
    found = L.lookup_approximate(table(spark, sf_dir, "customer"), "c_acctbal", table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", name="part")
    return found.select("c_custkey", "part")


@query("""WITH p AS (SELECT p_retailprice AS k, min(p_partkey) AS v FROM part GROUP BY 1)
    SELECT c_custkey, v AS part FROM customer ASOF LEFT JOIN p ON c_acctbal <= k""")
def match_desc(spark, sf_dir):
    """The smallest price that is not below: MATCH with -1."""
    found = L.lookup_approximate(table(spark, sf_dir, "customer"), "c_acctbal", table(spark, sf_dir, "part"), "p_retailprice", "p_partkey", forward=True, name="part")
    return found.select("c_custkey", "part")


@query("""WITH m AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS pos FROM nation)
    SELECT c_custkey, pos AS position, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN m USING (n_name)
    LEFT JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS rp FROM region) ON rp = pos""")
def index_match(spark, sf_dir):
    """MATCH of a nation's name, and INDEX of the regions at that position."""
    nations = table(spark, sf_dir, "nation")
    named = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("name"))
    at = L.match(named, "name", nations, "n_name", "n_nationkey")
    return L.index(at, "position", table(spark, sf_dir, "region"), "r_regionkey", "r_name", "region").select("c_custkey", F.col("position").cast("bigint").alias("position"), "region")


@query("SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN '1' WHEN 1 THEN 'AMERICA' END AS cell FROM supplier")
def hlookup_unpivot(spark, sf_dir):
    """HLOOKUP: header by key, cell of row 3."""
    regions = table(spark, sf_dir, "region")
    asked = table(spark, sf_dir, "supplier").withColumn("header", F.element_at(F.array(F.lit("r_key"), F.lit("r_name"), F.lit("missing")), (F.col("s_nationkey") % 3 + 1).cast("int")))
    sheet = regions.select(F.col("r_regionkey").alias("order"), F.col("r_regionkey").cast("string").alias("r_key"), "r_name")
    return L.hlookup(asked, "header", sheet, 3, "order", "cell").select("s_suppkey", "cell")


@query("""SELECT o_orderkey, count(*) AS days FROM orders JOIN range(DATE '1990-01-01', DATE '2031-01-01', INTERVAL 1 DAY) t(d)
    ON d BETWEEN o_orderdate::DATE AND o_orderdate::DATE + 9 AND dayofweek(d) BETWEEN 1 AND 5 AND strftime(d, '%m-%d') <> '12-25' GROUP BY 1""")
def networkdays_calendar(spark, sf_dir):
    """NETWORKDAYS from the order date over ten days, Christmas being a holiday."""
    start = DT.from_date("o_orderdate")
    holidays = [(date(y, 12, 25) - date(1899, 12, 30)).days for y in range(1990, 2031)]
    days = DT.NETWORKDAYS(start, start + num(9), holidays)
    return table(spark, sf_dir, "orders").select("o_orderkey", days.value.cast("bigint").alias("days"))


def _spec(**more):
    return P.Pivot(rows=["l_returnflag"], columns=["l_linestatus"], values=[("l_quantity", "sum", "qty"), ("l_extendedprice", "average", "price")], **more)


@query("""SELECT coalesce(l_returnflag, 'Grand Total') AS l_returnflag, coalesce(l_linestatus, 'Grand Total') AS l_linestatus, round(sum(l_quantity), 2) AS qty,
    round(avg(l_extendedprice), 4) AS price, grouping(l_returnflag)::INT AS row_level, grouping(l_linestatus)::INT AS column_level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def pivot_grand_totals(spark, sf_dir):
    """A pivot with grand totals on both axes, in long form."""
    return _spec().long(table(spark, sf_dir, "lineitem")).withColumns({"qty": r("qty", 2), "price": r("price", 4)})


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F_qty, round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 4) AS F_price,
    round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O_qty, round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 4) AS O_price, 0 AS row_level FROM lineitem GROUP BY 1""")
def pivot_multi_value(spark, sf_dir):
    """A laid-out pivot of two values without totals."""
    wide = _spec(row_totals=False, column_totals=False).table(table(spark, sf_dir, "lineitem"), ["F", "O"])
    return wide.select("l_returnflag", *[r(c, 2 if c.endswith("qty") else 4).alias(c) for c in ("F_qty", "F_price", "O_qty", "O_price")], "row_level")


@query("""SELECT coalesce(l_returnflag, 'Grand Total') AS l_returnflag, coalesce(l_linestatus, 'Grand Total') AS l_linestatus, count(*) AS n,
    (grouping(l_returnflag) + grouping(l_linestatus))::INT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def pivot_subtotals(spark, sf_dir):
    """Nested subtotals."""
    return P.subtotals(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [("l_quantity", "count", "n")])


@query("""SELECT o_orderstatus, o_orderpriority, round(max(o_totalprice), 2) AS top FROM (SELECT DISTINCT o_orderstatus FROM orders)
    CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) USING (o_orderstatus, o_orderpriority) GROUP BY 1, 2""")
def pivot_empty_items(spark, sf_dir):
    """A pivot that shows its empty items."""
    o = table(spark, sf_dir, "orders")
    few = o.where("o_totalprice > 400000").groupBy("o_orderstatus", "o_orderpriority").agg(r(F.max("o_totalprice"), 2).alias("top"))
    return P.show_empty_items(few, o.select("o_orderstatus").distinct(), o.select("o_orderpriority").distinct())


@query("SELECT 'l_returnflag' AS field, count(DISTINCT l_returnflag) AS items FROM lineitem UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem")
def pivot_shared_items(spark, sf_dir):
    """Different items of pivot fields."""
    return P.shared_items(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"])


@query("""SELECT 'Total' AS c_name, count(c_nationkey) AS c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal FROM customer""")
def table_totals(spark, sf_dir):
    """The totals row of a table."""
    c = table(spark, sf_dir, "customer").select("c_name", "c_nationkey", "c_acctbal")
    return P.table_totals(c, {"c_nationkey": "count", "c_acctbal": "sum"}, ("c_name", "Total")).withColumn("c_acctbal", r("c_acctbal", 2))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_values(spark, sf_dir):
    """Auto-filter by a list of values."""
    return FL.filter_values(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_size > 45 OR p_size <= 3")
def filter_custom_and_or(spark, sf_dir):
    """Auto-filter by two comparisons joined by OR."""
    return FL.filter_custom(table(spark, sf_dir, "part"), "p_size", ">45", "<=3", both=False).select("p_partkey")


@query("SELECT o_orderkey FROM orders QUALIFY rank() OVER (ORDER BY o_totalprice DESC) <= 25")
def filter_top_n(spark, sf_dir):
    """Auto-filter by the 25 highest prices."""
    return FL.filter_top(table(spark, sf_dir, "orders"), "o_totalprice", 25).select("o_orderkey")


@query("SELECT o_orderkey FROM orders QUALIFY rank() OVER (ORDER BY o_totalprice) <= (SELECT ceil(count(*) * 0.01) FROM orders)")
def filter_top_percent(spark, sf_dir):
    """Auto-filter by the lowest percent of prices."""
    return FL.filter_top(table(spark, sf_dir, "orders"), "o_totalprice", 1, bottom=True, percent=True).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def filter_above_average(spark, sf_dir):
    """Auto-filter above the average."""
    return FL.filter_average(table(spark, sf_dir, "orders"), "o_totalprice").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1995-02-01' AND o_orderdate < DATE '1995-03-01'")
def filter_dynamic_dates(spark, sf_dir):
    """Auto-filter by the month before a given day."""
    return FL.filter_dates(table(spark, sf_dir, "orders"), "o_orderdate", "lastMonth", "1995-03-17").select("o_orderkey")


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
def sort_rows_stable(spark, sf_dir):
    """A stable descending sort, shown as places."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return numbered(s, [F.desc_nulls_last("s_acctbal"), F.asc("s_suppkey")], "place").select("s_suppkey", "place")


@query("""SELECT l_orderkey, l_linenumber, l_quantity BETWEEN 10 AND 20 AS mid, l_returnflag = 'R' AS back, lower(l_linestatus) LIKE 'o%' AS open FROM lineitem""")
def cf_flags(spark, sf_dir):
    """Flags of cell rules."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", FL.cell_is("l_quantity", "between", 10, 20).alias("mid"), FL.cell_is("l_returnflag", "equal", "R").alias("back"), FL.cell_is("l_linestatus", "beginsWith", "O").alias("open"))


@query("""WITH b AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), p AS (SELECT s_suppkey, (s_acctbal - lo) / (hi - lo) AS t FROM supplier, b)
    SELECT s_suppkey, '#' || printf('%02X', floor(255 - 255 * t + 0.5)::INT) || printf('%02X', floor(255 * t + 0.5)::INT) || '00' AS color, round(10 + t * 80, 6) AS bar FROM p""")
def cf_color_scale(spark, sf_dir):
    """A two-colour scale and data bars."""
    s = FL.color_scale(table(spark, sf_dir, "supplier"), "s_acctbal", [(255, 0, 0), (0, 255, 0)])
    return FL.data_bar(s, "s_acctbal").select("s_suppkey", "color", r("bar").alias("bar"))


@query("""WITH b AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT p_partkey, (CASE WHEN (p_size - lo) / (hi - lo)::DOUBLE >= 0.67 THEN 2
    WHEN (p_size - lo) / (hi - lo)::DOUBLE >= 0.33 THEN 1 ELSE 0 END)::INT AS icon FROM part, b""")
def cf_icon_set(spark, sf_dir):
    """Three icons."""
    return FL.icon_set(table(spark, sf_dir, "part"), "p_size").select("p_partkey", "icon")


@query("SELECT c_custkey FROM customer WHERE c_acctbal IN (SELECT c_acctbal FROM customer GROUP BY 1 HAVING count(*) > 1)")
def cf_duplicates(spark, sf_dir):
    """Duplicate values."""
    return FL.duplicates(table(spark, sf_dir, "customer"), "c_acctbal").select("c_custkey")


@query("SELECT o_orderkey FROM orders QUALIFY rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) <= 5")
def cf_top_in_group(spark, sf_dir):
    """The five highest of each priority."""
    return FL.rank_flags(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], 5).where("top").select("o_orderkey")


@query("""SELECT 'qty' AS rule, count(*) FILTER (WHERE l_quantity BETWEEN 1 AND 40 AND l_quantity = floor(l_quantity)) AS valid, count(*) FILTER (WHERE NOT (l_quantity BETWEEN 1 AND 40 AND l_quantity = floor(l_quantity))) AS invalid FROM lineitem
    UNION ALL SELECT 'flag', count(*) FILTER (WHERE l_returnflag IN ('A', 'N')), count(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N')) FROM lineitem
    UNION ALL SELECT 'length', count(*) FILTER (WHERE length(l_linestatus) <= 1), count(*) FILTER (WHERE length(l_linestatus) > 1) FROM lineitem
    UNION ALL SELECT 'tax', count(*) FILTER (WHERE l_tax < l_discount), count(*) FILTER (WHERE l_tax >= l_discount) FROM lineitem""")
def validation_report(spark, sf_dir):
    """Data validation rules, counted in one pass."""
    rules = {
        "qty": FL.validation("l_quantity", "whole", "between", 1, 40), "flag": FL.validation("l_returnflag", "list", items=["A", "N"]),
        "length": FL.validation("l_linestatus", "textLength", "lessThanOrEqual", 1), "tax": FL.validation("l_tax", "custom", a=F.col("l_tax") < F.col("l_discount")),
    }
    return FL.validation_report(table(spark, sf_dir, "lineitem"), rules)


def _sheet(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("row"), "n_nationkey", "n_name", "n_regionkey")
    return R.to_cells(n, "row", "Nations")


_CELLS_SQL = """(SELECT n_nationkey + 1 AS row, 1 AS col, n_nationkey::DOUBLE AS num, NULL AS txt FROM nation
    UNION ALL SELECT n_nationkey + 1, 2, NULL, n_name FROM nation UNION ALL SELECT n_nationkey + 1, 3, n_regionkey::DOUBLE, NULL FROM nation)"""


@query(f"SELECT row::BIGINT AS row, col::INT AS col, num, txt FROM {_CELLS_SQL}")
def cells_long(spark, sf_dir):
    """A table as sparse cells."""
    return _sheet(spark, sf_dir).select("row", "col", "num", "txt")


@query("SELECT (n_nationkey + 1)::BIGINT AS row, n_nationkey::VARCHAR AS key, n_name AS name FROM nation")
def cells_roundtrip(spark, sf_dir):
    """Cells back as a table."""
    return R.from_cells(_sheet(spark, sf_dir), {1: "key", 2: "name"})


@query(f"SELECT (CASE WHEN row >= 5 THEN row + 3 ELSE row END)::BIGINT AS row, (CASE WHEN col > 2 THEN col - 1 ELSE col END)::INT AS col, num, txt FROM {_CELLS_SQL} WHERE col <> 2")
def insert_rows_shift(spark, sf_dir):
    """Three rows put in before row 5, column 2 deleted."""
    return R.delete_columns(R.insert_rows(_sheet(spark, sf_dir), 5, 3), 2, 1).select("row", "col", "num", "txt")


@query(f"""WITH c AS (SELECT * FROM {_CELLS_SQL}), m AS (SELECT row + 1 AS row, col + 1 AS col, num, txt FROM c WHERE row BETWEEN 1 AND 3 AND col BETWEEN 1 AND 2)
    SELECT row::BIGINT AS row, col::INT AS col, num, txt FROM m UNION ALL SELECT row, col, num, txt FROM c WHERE (row, col) NOT IN (SELECT (row, col) FROM m)""")
def range_copy_upsert(spark, sf_dir):
    """A range copied onto one that it overlaps."""
    return R.copy_range(_sheet(spark, sf_dir), 1, 1, 3, 2, 2, 2).select("row", "col", "num", "txt")


@query(f"SELECT col::BIGINT AS row, row::INT AS col, num, txt FROM {_CELLS_SQL}")
def range_transpose(spark, sf_dir):
    """Rows and columns swapped."""
    return R.transpose(_sheet(spark, sf_dir)).select("row", "col", "num", "txt")


@query("SELECT (n_nationkey + 1)::BIGINT AS row, 2 AS col FROM nation WHERE contains(n_name, '1') UNION ALL SELECT n_nationkey + 1, 1 FROM nation WHERE contains(n_nationkey::VARCHAR, '1') UNION ALL SELECT n_nationkey + 1, 3 FROM nation WHERE contains(n_regionkey::VARCHAR, '1')")
def find_cells(spark, sf_dir):
    """Cells that show a 1."""
    return R.find_cells(_sheet(spark, sf_dir), "1").select("row", "col")


@query("SELECT (n_nationkey + 1)::BIGINT AS row, replace(n_name, 'A', '<a>') AS txt, (length(n_name) - length(replace(n_name, 'A', '')))::DOUBLE AS n FROM nation")
def replace_text(spark, sf_dir):
    """Find and replace in text cells, with counts."""
    cells = _sheet(spark, sf_dir).where("kind = 's'").withColumn("n", R.count_replacements(None, "A").cast("double"))
    return R.replace_text(cells, "A", "<a>").select("row", "txt", "n")


@query("""SELECT chr(64 + col) || row || ': ' || coalesce(txt, num::BIGINT::VARCHAR) AS line FROM """ + _CELLS_SQL)
def ir_derive_lines(spark, sf_dir):
    """The line form of a sheet."""
    return T.derive_lines(_sheet(spark, sf_dir)).select("line")


@query(f"SELECT row::BIGINT AS row, col::INT AS col, num, txt FROM {_CELLS_SQL}")
def ir_parse_lines(spark, sf_dir):
    """The line form read back: the same cells."""
    return T.parse_lines(T.derive_lines(_sheet(spark, sf_dir))).select("row", "col", "num", "txt")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def lint_orphans(spark, sf_dir):
    """References to rows that are not there."""
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return table(spark, sf_dir, "orders").join(good, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_extendedprice - round(l_extendedprice / l_quantity, 1) * l_quantity) > 1e-9")
def lint_cache_mismatch(spark, sf_dir):
    """Stored values that differ from computed ones."""
    li = table(spark, sf_dir, "lineitem")
    return T.lint_cache(li, "l_extendedprice", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 1) * F.col("l_quantity")).select("l_orderkey", "l_linenumber")


@query("""SELECT scenario, r_name AS region, brand, 'n/a' AS member FROM (VALUES ('base'), ('high')) s(scenario) CROSS JOIN (SELECT DISTINCT r_name FROM region)
    CROSS JOIN (SELECT DISTINCT p_brand AS brand FROM part)""")
def finance_grid(spark, sf_dir):
    """A model's grid of scenarios, regions and brands; the dimension without members reads n/a."""
    brands = table(spark, sf_dir, "part").select("p_brand")
    return R.finance_grid(spark, {"region": table(spark, sf_dir, "region").select("r_name"), "brand": brands, "member": []}, ["base", "high"])


@query("SELECT n_name AS id, CASE WHEN n_nationkey < 2 THEN 'new' || n_nationkey ELSE 'old' END AS text FROM nation")
def apply_edit_groups(spark, sf_dir):
    """Edits in groups: one group holds an unknown id, and none of it applies."""
    n = table(spark, sf_dir, "nation")
    nodes = n.select(F.col("n_name").alias("id"), F.lit("old").alias("text"))
    good = n.where("n_nationkey < 2").select(F.col("n_name").alias("id"), F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("text"), F.lit("a").alias("group"))
    bad = n.where("n_nationkey = 5").select(F.col("n_name").alias("id"), F.lit("x").alias("text"), F.lit("b").alias("group"))
    return T.apply_edits(nodes, good.unionByName(bad).unionByName(bad.withColumn("id", F.lit("nowhere"))))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def events_row_program(spark, sf_dir):
    """A row program of cells over events, then a sum; the same code runs on a stream."""
    rows = rowwise.with_cells(table(spark, sf_dir, "events"), {"double": num("value") + num("value")})
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("double") / 2, 4).alias("total"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_windowed(spark, sf_dir):
    """Hourly aggregates with a watermark; in a batch all rows count."""
    out = rowwise.windowed(table(spark, sf_dir, "events"), "ts", ["event_type"], {"n": A.COUNT("event_id"), "total": A.SUM("value")})
    return out.withColumn("total", r("total", 4))
