"""Queries over range aggregates, criteria and database functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import aggregates as A
from quillgrid.operators import criteria as C
from quillgrid.operators import database as D

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c, n=6):
    return F.round(c, n)


@query("SELECT round(sum(l_quantity) + sum(l_tax) + sum(l_discount), 4) AS total FROM lineitem")
def range_sum_multi(spark, sf_dir):
    """SUM over three columns."""
    return table(spark, sf_dir, "lineitem").agg(r(A.SUM("l_quantity", "l_tax", "l_discount"), 4).alias("total"))


@query("""SELECT round(avg(l_extendedprice), 6) AS average, min(l_extendedprice) AS least, max(l_extendedprice) AS most,
    median(l_quantity) AS middle, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp,
    round(var_samp(l_quantity), 6) AS v, round(var_pop(l_quantity), 6) AS vp FROM lineitem""")
def range_stats(spark, sf_dir):
    """AVERAGE, MIN, MAX, MEDIAN, STDEV, STDEVP, VAR and VARP in one pass."""
    return table(spark, sf_dir, "lineitem").agg(
        r(A.AVERAGE("l_extendedprice")).alias("average"), A.MIN("l_extendedprice").alias("least"), A.MAX("l_extendedprice").alias("most"),
        A.MEDIAN("l_quantity").alias("middle"), r(A.STDEV("l_quantity")).alias("sd"), r(A.STDEVP("l_quantity")).alias("sdp"),
        r(A.VAR("l_quantity")).alias("v"), r(A.VARP("l_quantity")).alias("vp"),
    )


@query("""SELECT count(o_totalprice) AS n_numbers, count(o_orderpriority) AS n_filled,
    count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderstatus, 'P') = '') AS n_blank FROM orders""")
def count_family(spark, sf_dir):
    """COUNT, COUNTA and COUNTBLANK; status P stands for blanks."""
    o = table(spark, sf_dir, "orders").withColumn("status", F.nullif(F.col("o_orderstatus"), F.lit("P")))
    return o.agg(A.COUNT("o_totalprice").alias("n_numbers"), A.COUNTA("o_orderpriority").alias("n_filled"), A.COUNTBLANK("status").alias("n_blank"))


@query("""WITH m AS (SELECT avg(l_quantity) AS mean FROM lineitem) SELECT round(exp(avg(ln(l_quantity))), 6) AS geomean,
    round(var_pop(l_quantity) * count(*), 2) AS devsq, round(avg(abs(l_quantity - mean)), 6) AS avedev FROM lineitem, m""")
def geomean_devsq(spark, sf_dir):
    """GEOMEAN, DEVSQ and AVEDEV."""
    li = table(spark, sf_dir, "lineitem")
    one = li.agg(r(A.GEOMEAN("l_quantity")).alias("geomean"), r(A.DEVSQ("l_quantity"), 2).alias("devsq"))
    return one.join(F.broadcast(A.AVEDEV(li, "l_quantity").select(r("avedev").alias("avedev"))))


@query("SELECT l_extendedprice AS large FROM lineitem ORDER BY 1 DESC LIMIT 1 OFFSET 9")
def large_k(spark, sf_dir):
    """LARGE with k = 10."""
    return A.LARGE(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10).select("large")


@query("SELECT l_extendedprice AS small FROM lineitem ORDER BY 1 LIMIT 1 OFFSET 4")
def small_k(spark, sf_dir):
    """SMALL with k = 5."""
    return A.SMALL(table(spark, sf_dir, "lineitem"), "l_extendedprice", 5).select("small")


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem")
def sumproduct_revenue(spark, sf_dir):
    """SUMPRODUCT of the price and one less the discount."""
    return table(spark, sf_dir, "lineitem").agg(r(A.SUMPRODUCT("l_extendedprice", 1 - F.col("l_discount")), 2).alias("revenue"))


@query("""SELECT round(sum(l_quantity * l_quantity - l_tax * l_tax), 4) AS a, round(sum(l_quantity * l_quantity + l_tax * l_tax), 4) AS b,
    round(sum((l_quantity - l_tax) * (l_quantity - l_tax)), 4) AS c, round(sum(l_discount * l_discount), 6) AS d FROM lineitem""")
def sumxmy2(spark, sf_dir):
    """SUMX2MY2, SUMX2PY2, SUMXMY2 and SUMSQ."""
    return table(spark, sf_dir, "lineitem").agg(
        r(A.SUMX2MY2("l_quantity", "l_tax"), 4).alias("a"), r(A.SUMX2PY2("l_quantity", "l_tax"), 4).alias("b"),
        r(A.SUMXMY2("l_quantity", "l_tax"), 4).alias("c"), r(A.SUMSQ("l_discount"), 6).alias("d"),
    )


@query("SELECT l_returnflag, round(1e6 * ln(product(1 + l_tax / 1e6)), 3) AS log_grown FROM lineitem GROUP BY 1")
def product_by_flag(spark, sf_dir):
    """PRODUCT within the groups of a criterion, shown as a logarithm; its factors overflow from some 10**10 rows a group."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("g", 1 + F.col("l_tax") / 1e6).groupBy("l_returnflag").agg(r(1e6 * F.ln(A.PRODUCT("g")), 3).alias("log_grown"))


@query("""SELECT list_reduce((SELECT list(DISTINCT (p_size * 6)::BIGINT) FROM part), lambda a, b: gcd(a, b))::DOUBLE AS gcd,
    list_reduce((SELECT list(DISTINCT (n_nationkey)::BIGINT) FROM nation WHERE n_nationkey > 0), lambda a, b: lcm(a, b))::DOUBLE AS lcm""")
def gcd_lcm_constants(spark, sf_dir):
    """GCD of six times the parts' sizes, LCM of the nations' keys."""
    a = A.GCD_LCM(table(spark, sf_dir, "part").select((F.col("p_size") * 6).alias("x")), "x").select("gcd")
    b = A.GCD_LCM(table(spark, sf_dir, "nation").where("n_nationkey > 0"), "n_nationkey").select("lcm")
    return a.join(F.broadcast(b))


@query("""SELECT count(*) FILTER (WHERE l_quantity > 25) AS gt, count(*) FILTER (WHERE l_quantity <> 10) AS ne,
    count(*) FILTER (WHERE l_quantity = 10) AS eq, count(*) FILTER (WHERE l_discount <= 0.05) AS le FROM lineitem""")
def countif_ops(spark, sf_dir):
    """COUNTIF with comparison criteria."""
    li = table(spark, sf_dir, "lineitem")
    return li.agg(
        C.COUNTIF(li, "l_quantity", ">25").alias("gt"), C.COUNTIF(li, "l_quantity", "<>10").alias("ne"),
        C.COUNTIF(li, "l_quantity", 10).alias("eq"), C.COUNTIF(li, "l_discount", "<=0.05").alias("le"),
    )


@query("""SELECT count(*) FILTER (WHERE lower(c_mktsegment) LIKE 'b%') AS starts, count(*) FILTER (WHERE lower(c_mktsegment) LIKE '%e%y') AS inside,
    count(*) FILTER (WHERE lower(c_mktsegment) NOT LIKE 'b%') AS others, count(*) FILTER (WHERE lower(c_mktsegment) LIKE '_uilding') AS one FROM customer""")
def countif_wildcard(spark, sf_dir):
    """COUNTIF with wildcards."""
    c = table(spark, sf_dir, "customer")
    return c.agg(
        C.COUNTIF(c, "c_mktsegment", "b*").alias("starts"), C.COUNTIF(c, "c_mktsegment", "*E*Y").alias("inside"),
        C.COUNTIF(c, "c_mktsegment", "<>b*").alias("others"), C.COUNTIF(c, "c_mktsegment", "?uilding").alias("one"),
    )


@query("""SELECT count(*) FILTER (WHERE nullif(o_orderstatus, 'F') IS NULL) AS blanks, count(*) FILTER (WHERE nullif(o_orderstatus, 'F') IS NOT NULL) AS filled FROM orders""")
def countif_blank(spark, sf_dir):
    """COUNTIF with = and <>; status F stands for blanks."""
    o = table(spark, sf_dir, "orders").withColumn("s", F.nullif(F.col("o_orderstatus"), F.lit("F")))
    return o.agg(C.COUNTIF(o, "s", "=").alias("blanks"), C.COUNTIF(o, "s", "<>").alias("filled"))


@query("SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_returnflag = 'R' AND l_discount < 0.05")
def countifs_pairs(spark, sf_dir):
    """COUNTIFS over three columns; the criteria are a pushed-down filter as well as a count."""
    li = table(spark, sf_dir, "lineitem")
    return li.where(C.criteria(li, "l_quantity", ">=10", "l_returnflag", "r", "l_discount", "<0.05")).agg(F.count("*").alias("n"))


@query("""SELECT round(sum(l_extendedprice) FILTER (WHERE l_quantity < 10), 2) AS a,
    round(sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F'), 2) AS b,
    round(avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N'), 6) AS c FROM lineitem""")
def sumifs_ext(spark, sf_dir):
    """SUMIF, SUMIFS and AVERAGEIFS."""
    li = table(spark, sf_dir, "lineitem")
    return li.agg(
        r(C.SUMIF(li, "l_quantity", "<10", "l_extendedprice"), 2).alias("a"),
        r(C.SUMIFS(li, "l_extendedprice", "l_returnflag", "A", "l_linestatus", "F"), 2).alias("b"),
        r(C.AVERAGEIFS(li, "l_extendedprice", "l_returnflag", "N"), 6).alias("c"),
    )


@query("SELECT round(sum(l_extendedprice), 2) AS s9, count(l_extendedprice) AS s2, max(l_extendedprice) AS s4, round(avg(l_extendedprice), 6) AS s101 FROM lineitem")
def subtotal_codes(spark, sf_dir):
    """SUBTOTAL 9, 2, 4 and 101."""
    p = "l_extendedprice"
    return table(spark, sf_dir, "lineitem").agg(r(A.SUBTOTAL(9, p), 2).alias("s9"), A.SUBTOTAL(2, p).alias("s2"), A.SUBTOTAL(4, p).alias("s4"), r(A.SUBTOTAL(101, p)).alias("s101"))


_LINES = [{"L_Quantity": ">=40", "l_returnflag": "R"}, {"l_discount": "<0.02"}]
_WHERE = "(l_quantity >= 40 AND l_returnflag = 'R') OR l_discount < 0.02"


def _database(name: str, call, select: str, digits: int):
    def f(spark, sf_dir):
        return call(table(spark, sf_dir, "lineitem"), "l_extendedprice", _LINES).select(F.round("value", digits).alias("value"), "error")

    f.__name__ = name
    f.__doc__ = f"{name.upper()} of the price over two criteria lines."
    QUERIES[name] = f
    ORACLES[name] = f"SELECT round({select}, {digits}) AS value, CAST(NULL AS VARCHAR) AS error FROM lineitem WHERE {_WHERE}"


for _name, _call, _select, _digits in (
    ("daverage", D.DAVERAGE, "avg(l_extendedprice)", 6), ("dcount", D.DCOUNT, "count(l_extendedprice)::DOUBLE", 0), ("dcounta", D.DCOUNTA, "count(l_extendedprice)::DOUBLE", 0),
    ("dmax", D.DMAX, "max(l_extendedprice)", 6), ("dmin", D.DMIN, "min(l_extendedprice)", 6), ("dstdev", D.DSTDEV, "stddev_samp(l_extendedprice)", 4),
    ("dstdevp", D.DSTDEVP, "stddev_pop(l_extendedprice)", 4), ("dvar", D.DVAR, "var_samp(l_extendedprice)", 0), ("dvarp", D.DVARP, "var_pop(l_extendedprice)", 0),
):
    _database(_name, _call, _select, _digits)


@query(f"SELECT round(coalesce(sum(l_extendedprice), 0.0), 2) AS dsum FROM lineitem WHERE {_WHERE}")
def dsum_block(spark, sf_dir):
    """DSUM of the price over two criteria lines: the block is one pushed-down filter under a partial aggregate."""
    return D.DSUM(table(spark, sf_dir, "lineitem"), "l_extendedprice", _LINES).select(F.round("value", 2).alias("dsum"))


@query("SELECT round(product(p_size), 0) AS value FROM part WHERE p_partkey BETWEEN 3 AND 8")
def dproduct(spark, sf_dir):
    """DPRODUCT over a line with two conditions on one field's copies."""
    p = table(spark, sf_dir, "part").withColumn("key2", F.col("p_partkey"))
    return D.DPRODUCT(p, "p_size", [{"p_partkey": ">=3", "key2": "<=8"}]).select(F.round("value", 0).alias("value"))


@query("""SELECT 'one' AS what, max(c_name) AS value, CAST(NULL AS VARCHAR) AS error FROM customer WHERE c_custkey = 7
    UNION ALL SELECT 'none', NULL, '#VALUE!' UNION ALL SELECT 'many', NULL, '#NUM!'""")
def dget(spark, sf_dir):
    """DGET of one, no and many rows."""
    c = table(spark, sf_dir, "customer")
    cases = {"one": {"c_custkey": 7}, "none": {"c_custkey": "<0"}, "many": {"c_custkey": "<50"}}
    parts = [D.DGET(c, "c_name", [line]).select(F.lit(k).alias("what"), "value", "error") for k, line in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
