"""Scalar functions on single values, with their error codes."""

import math
from datetime import date

import pytest

from quillgrid.functions import dates as DT
from quillgrid.functions import logic as LG
from quillgrid.functions import mathematics as M
from quillgrid.functions import numfmt
from quillgrid.functions import strings as S
from quillgrid.functions.cells import DIV0, NA, NUM, VALUE, blank, boolean, cell, num, text, to_number, to_text
from quillgrid.functions.registry import Registry
from pyspark.sql import functions as F

SERIAL = lambda y, m, d: float((date(y, m, d) - date(1899, 12, 30)).days)

def cases():
    return [
    (M.ROUND(2.5, 0), 3.0), (M.ROUND(-2.5, 0), -3.0), (M.ROUND(1.005, 2), 1.0), (M.ROUND(1234.5, -2), 1200.0), (M.ROUNDUP(-1.21, 1), -1.3),
    (M.MOD(-3, 2), 1.0), (M.MOD(3, 0), DIV0), (M.POWER(0, 0), NUM), (M.POWER(0, -1), DIV0), (M.POWER(-8, 0.5), NUM), (M.SQRT(-1), NUM),
    (M.LOG(8, 2), 3.0), (M.LOG(1, 1), NUM), (M.LN(0), NUM), (M.EXP(1000), NUM), (M.ATAN2(1, 1), math.pi / 4), (M.ATAN2(0, 0), DIV0), (M.ACOS(2), NUM),
    (M.CEILING(2.5, 0), 0.0), (M.CEILING(2.5, -2), NUM), (M.FLOOR(2.5, 0), DIV0), (M.CEILING_MATH(-5.5, 2), -4.0), (M.CEILING_MATH(-5.5, 2, 1), -6.0),
    (M.FLOOR_MATH(-5.5, 2), -6.0), (M.FLOOR_MATH(-5.5, 2, 1), -4.0), (M.EVEN(-1.5), -2.0), (M.ODD(0), 1.0), (M.MROUND(7, 3), 6.0), (M.MROUND(-7, 3), NUM),
    (M.FACT(5), 120.0), (M.FACT(-1), NUM), (M.FACT(171), NUM), (M.FACTDOUBLE(7), 105.0), (M.COMBIN(5, 2), 10.0), (M.COMBIN(2, 5), NUM), (M.COMBINA(4, 3), 20.0),
    (M.GCD(12, 18), 6.0), (M.LCM(4, 6), 12.0), (M.MULTINOMIAL(2, 3, 4), 1260.0), (M.ROMAN(1994), "MCMXCIV"), (M.ROMAN(0), ""), (M.ROMAN(4000), VALUE),
    (M.ARABIC("mcmxciv"), 1994.0), (M.ARABIC("-X"), -10.0), (M.ARABIC("Q"), VALUE), (M.BASE(255, 16, 4), "00FF"), (M.DECIMAL("ff", 16), 255.0), (M.DECIMAL("9", 8), NUM),
    (M.QUOTIENT(-7, 2), -3.0), (M.SERIESSUM(2, 0, 1, [1, 1, 1]), 7.0), (M.BINOM_DIST(1, 3, 0.5, False), 0.375), (M.BINOM_DIST(1, 3, 0.5, True), 0.5), (M.FISHER(1), NUM),
    (M.COT(0), DIV0), (M.TAN(134217728), NUM), (M.SIGN(-3), -1.0), (M.INT(-1.5), -2.0),
    (S.LEFT("abc", -1), VALUE), (S.LEFT("abc", 2), "ab"), (S.RIGHT("abc", 2), "bc"), (S.MID("abcdef", 2, 3), "bcd"), (S.MID("abc", 0, 1), VALUE), (S.TRIM("  a   b "), "a b"),
    (S.PROPER("john o'neil-x 2day"), "John O'Neil-X 2Day"), (S.FIND("b", "abcb", 3), 4.0), (S.FIND("z", "abc"), VALUE), (S.SEARCH("B?D", "abcde"), 2.0), (S.SEARCH("~*", "a*b"), 2.0),
    (S.REPLACE("abcdef", 2, 3, "X"), "aXef"), (S.SUBSTITUTE("a-b-c", "-", "+"), "a+b+c"), (S.SUBSTITUTE("a-b-c", "-", "+", 2), "a-b+c"), (S.SUBSTITUTE("abc", "", "x"), "abc"),
    (S.REPT("ab", 3), "ababab"), (S.REPT("a", -1), VALUE), (S.CHAR(65), "A"), (S.CHAR(128), "€"), (S.CHAR(0), VALUE), (S.CODE("€uro"), 128.0), (S.CODE(""), VALUE), (S.CODE("é"), 233.0),
    (S.CLEAN("a\x07b"), "ab"), (S.ASC("ＡＢ"), "AB"), (S.T(5), ""), (S.FIXED(1234.567, 1), "1,234.6"), (S.FIXED(1234.567, 1, True), "1234.6"), (S.DOLLAR(-1234.5), "$-1,234.50"),
    (S.NUMBERVALUE("1.234,5 %", ",", "."), 12.345), (S.NUMBERVALUE(""), 0.0), (S.NUMBERVALUE("x"), VALUE), (S.VALUE_OF("12%"), 0.12), (S.VALUE_OF(True), VALUE), (S.TEXTJOIN("-", True, "a", "", "b"), "a-b"),
    (S.TEXTJOIN("-", False, "a", "", "b"), "a--b"), (S.EXACT("a", "A"), False), (S.LEN("é"), 1.0), (S.LENB("é"), 2.0), (S.LEFTB("éa", 2), "é"), (S.TEXT(0.256, "0.0%"), "25.6%"),
    (DT.DATE(2024, 14, 31), SERIAL(2025, 3, 3)), (DT.DATE(100, 1, 1), SERIAL(2000, 1, 1)), (DT.YEAR(SERIAL(2024, 2, 29)), 2024.0), (DT.DAY(SERIAL(2024, 2, 29)), 29.0), (DT.YEAR(-1), NUM),
    (DT.DATE(1900, 1, 1), 1.0), (DT.MONTH(1), 1.0), (DT.HOUR(0.75), 18.0), (DT.MINUTE(0.5 + 7 / 1440), 7.0), (DT.SECOND(0.99999999), 0.0), (DT.TIME(27, 0, 0), 0.125), (DT.TIME(-1, 0, 0), NUM),
    (DT.EDATE(SERIAL(2024, 1, 31), 1), SERIAL(2024, 2, 29)), (DT.EOMONTH(SERIAL(2024, 1, 15), 1), SERIAL(2024, 2, 29)), (DT.WEEKDAY(SERIAL(2024, 1, 7)), 1.0), (DT.WEEKDAY(SERIAL(2024, 1, 7), 2), 7.0),
    (DT.WEEKDAY(1, 9), NUM), (DT.ISOWEEKNUM(SERIAL(2024, 1, 7)), 1.0), (DT.WEEKNUM(SERIAL(2024, 1, 7)), 2.0), (DT.DAYS360(SERIAL(2024, 1, 31), SERIAL(2024, 3, 31)), 60.0),
    (DT.DATEDIF(SERIAL(2024, 1, 31), SERIAL(2025, 3, 1), "Y"), 1.0), (DT.DATEDIF(SERIAL(2024, 1, 31), SERIAL(2024, 3, 1), "M"), 1.0), (DT.DATEDIF(2.0, 1.0, "D"), NUM),
    (DT.NETWORKDAYS(SERIAL(2024, 1, 1), SERIAL(2024, 1, 7)), 5.0), (DT.NETWORKDAYS(SERIAL(2024, 1, 7), SERIAL(2024, 1, 1)), -5.0), (DT.NETWORKDAYS(SERIAL(2024, 1, 1), SERIAL(2024, 1, 7), [SERIAL(2024, 1, 1)]), 4.0),
    (DT.WORKDAY(SERIAL(2024, 1, 5), 1), SERIAL(2024, 1, 8)), (DT.WORKDAY(SERIAL(2024, 1, 6), -1), SERIAL(2024, 1, 5)), (DT.WORKDAY(SERIAL(2024, 1, 5), 2, [SERIAL(2024, 1, 8)]), SERIAL(2024, 1, 10)),
    (DT.YEARFRAC(SERIAL(2024, 1, 1), SERIAL(2024, 7, 1)), 0.5), (DT.YEARFRAC(1.0, 2.0, 7), NUM), (DT.DATEVALUE("2024-02-29"), SERIAL(2024, 2, 29)), (DT.DATEVALUE("no"), VALUE), (DT.TIMEVALUE("6:00 PM"), 0.75),
    (LG.IF(True, 1, num(1) / 0), 1.0), (LG.IF("x", 1, 2), VALUE), (LG.IFERROR(num(1) / 0, 7), 7.0), (LG.ISNA(LG.NA_VALUE()), True), (LG.ISERR(LG.NA_VALUE()), False), (LG.ISBLANK(None), True), (LG.ISBLANK(""), False),
    (LG.ISEVEN(None), NA), (LG.ISEVEN(True), VALUE), (LG.ISODD(-3), True), (LG.N("x"), 0.0), (LG.TYPE("x"), 2.0), (LG.TYPE(num(1) / 0), 16.0), (LG.ERROR_TYPE(num(1) / 0), 2.0), (LG.ERROR_TYPE(1), NA),
    (LG.CHOOSE(2, "a", "b"), "b"), (LG.CHOOSE(3, "a", "b"), VALUE), (LG.ADDRESS(2, 28), "$AB$2"), (LG.ADDRESS(2, 3, 2), "C$2"), (LG.ADDRESS(2, 3, 4, False), "R[2]C[3]"), (LG.INDEX_OF([5, 6], 3), "#REF!"),
    (LG.PMT(0, 10, 100), -10.0), (LG.PMT(0.01, 0, 1), NUM), (LG.FV(0.01, 0, 5, 100), -100.0), (LG.IPMT(0.1, 1, 3, 8000), -800.0), (LG.AND(True, 1, "TRUE"), True), (LG.NOT("x"), VALUE),
    (num(1) + text("2"), 3.0), (num(1) + text("x"), VALUE), (num(1) + blank(), 1.0), (boolean(True) + num(1), 2.0), (num(1) / num(0), DIV0), (num(1) & "a", "1a"), ((-num(2)) ** num(2), 4.0),
    (cell(None).compare("=", 0), False), (cell("a").compare("=", "A"), True), (cell(5).compare("<", "a"), True), (cell(True).compare(">", "z"), True), (to_text(1e20), "100000000000000000000"), (to_text(0.1), "0.1"),
    (to_number(" 1e3 "), 1000.0), (to_number("1d"), VALUE),
]


def test_scalar_cases(spark):
    CASES = cases()
    columns = [F.coalesce(c.error, c.value.cast("string")).alias(f"c{i}") if c.error is not None else c.value.cast("string").alias(f"c{i}") for i, (c, _) in enumerate(CASES)]
    for low in range(0, len(CASES), 40):
        row = spark.range(1).select(*columns[low : low + 40]).first()
        for i, got in enumerate(row, low):
            want = CASES[i][1]
            if isinstance(want, bool):
                assert got == str(want).lower(), (i, got, want)
            elif isinstance(want, float):
                assert got is not None and float(got) == pytest.approx(want, abs=1e-9), (i, got, want)
            else:
                assert got == want, (i, got, want)


FORMATS = [
    (1234.5, "#,##0.00", "1,234.50"), (-3.0, "0;(0)", "(3)"), (0.0, '0;-0;"zero"', "zero"), (0.125, "0.0%", "12.5%"), (12345.678, "0.00E+00", "1.23E+04"), (1.5, "# ?/?", "1 1/2"),
    (45292.0, "yyyy-mm-dd", "2024-01-01"), (45292.75, "h:mm AM/PM", "6:00 PM"), (1.5, "[h]:mm:ss", "36:00:00"), (7.0, "000", "007"), (1234567.0, '0.0,,"M"', "1.2M"), (12.345, "bps1", "12.3 bps"), (2.5, "multiple2", "2.50x"), (25e6, "usd_millions1", "$25.0 mm"), (0.0, 41, " - "), (1.0, "General", "1"),
    (0.5, "#.##", ".5"), (45292.0, 14, "01-01-24"),
]


def test_number_formats(spark):
    row = spark.range(1).select(*[numfmt.format_number(F.lit(x), code).alias(f"f{i}") for i, (x, code, _) in enumerate(FORMATS)]).first()
    assert list(row) == [want for *_, want in FORMATS]
    assert spark.range(1).select(numfmt.format_number(F.lit(None), "0.00").alias("x")).first()["x"] is None
    assert numfmt.is_date("d-mmm") and not numfmt.is_date('0.00 "days"')


def test_registry(spark):
    known = Registry()
    known.register("double", lambda x: to_number(x) + to_number(x))
    row = spark.range(1).select(known.call("DOUBLE", 4).value.alias("a"), known.call("nope").error.alias("b"), known.call("ABS").error.alias("c"), known.call("ceiling.math", 2.2).value.alias("d")).first()
    assert tuple(row) == (8.0, "#NAME?", "#VALUE!", 3.0)
