"""Mathematical and trigonometric functions over cells. Angles are in radians; codes are those of spreadsheets."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.cells import DIV0, NUM, VALUE, Cell, arithmetic, cell, checked, made, num, number, to_number, to_text

_INF = float("inf")


def _odd(x: Column) -> Column:
    return (x - 2 * F.floor(x / 2)) != 0


def _scale(digits: Column) -> Column:
    return F.pow(F.lit(10.0), digits)


def ABS(x) -> Cell:
    return number(x, F.abs)


def half_away(x: Column, digits: Column) -> Column:
    """Rounds half away from zero as floor(|x| * 10^d + 0.5) / 10^d; 15 digits and more leave x alone, and so does a product
    beyond a long, which has no fraction."""
    f = _scale(F.floor(digits))
    return F.when((digits >= 15) | (F.abs(x) * f >= float(2**63)), x).otherwise(F.signum(x) * F.floor(F.abs(x) * f + 0.5) / f)


def ROUND(x, digits=0) -> Cell:
    return arithmetic(x, digits, half_away)


def ROUNDUP(x, digits=0) -> Cell:
    return arithmetic(x, digits, lambda a, d: F.signum(a) * F.ceil(F.abs(a) * _scale(F.floor(d))) / _scale(F.floor(d)))


def ROUNDDOWN(x, digits=0) -> Cell:
    return arithmetic(x, digits, lambda a, d: F.signum(a) * F.floor(F.abs(a) * _scale(F.floor(d))) / _scale(F.floor(d)))


TRUNC = ROUNDDOWN


def INT(x) -> Cell:
    return number(x, lambda a: F.floor(a).cast("double"))


def MOD(n, d) -> Cell:
    """n - d * floor(n / d): the sign of the divisor."""
    return arithmetic(n, d, lambda a, b: a - b * F.floor(a / b), lambda a, b: [(b == 0, DIV0)])


def QUOTIENT(n, d) -> Cell:
    return arithmetic(n, d, lambda a, b: F.signum(a / b) * F.floor(F.abs(a / b)), lambda a, b: [(b == 0, DIV0)])


def POWER(x, y) -> Cell:
    def bad(a, b):
        return [((a == 0) & (b == 0), NUM), ((a == 0) & (b < 0), DIV0), ((a < 0) & (b != F.floor(b)), NUM)]

    return checked(arithmetic(x, y, F.pow, bad))


def SQRT(x) -> Cell:
    return number(x, F.sqrt, lambda a: [(a < 0, NUM)])


def SQRTPI(x) -> Cell:
    return number(x, lambda a: F.sqrt(a * math.pi), lambda a: [(a < 0, NUM)])


def PI() -> Cell:
    return num(math.pi)


def SIGN(x) -> Cell:
    return number(x, F.signum)


def LOG(x, base=10) -> Cell:
    return arithmetic(x, base, lambda a, b: F.ln(a) / F.ln(b), lambda a, b: [((a <= 0) | (b <= 0) | (F.abs(b - 1) < 1e-10), NUM)])


def LN(x) -> Cell:
    return number(x, F.ln, lambda a: [(a <= 0, NUM)])


def LOG10(x) -> Cell:
    return number(x, F.log10, lambda a: [(a <= 0, NUM)])


def EXP(x) -> Cell:
    return checked(number(x, F.exp))


def DEGREES(x) -> Cell:
    return number(x, F.degrees)


def RADIANS(x) -> Cell:
    return number(x, F.radians)


def ACOS(x) -> Cell:
    return number(x, F.acos, lambda a: [(F.abs(a) > 1, NUM)])


def ACOSH(x) -> Cell:
    return number(x, F.acosh, lambda a: [(a < 1, NUM)])


def ACOT(x) -> Cell:
    return number(x, lambda a: math.pi / 2 - F.atan(a))


def ACOTH(x) -> Cell:
    return number(x, lambda a: 0.5 * F.ln((a + 1) / (a - 1)), lambda a: [(F.abs(a) <= 1, NUM)])


def ASIN(x) -> Cell:
    return number(x, F.asin, lambda a: [(F.abs(a) > 1, NUM)])


def ASINH(x) -> Cell:
    return number(x, F.asinh)


def ATAN(x) -> Cell:
    return number(x, F.atan)


def ATAN2(x, y) -> Cell:
    """The angle of the point (x, y): x comes first."""
    return arithmetic(x, y, lambda a, b: F.atan2(b, a), lambda a, b: [((a == 0) & (b == 0), DIV0)])


def ATANH(x) -> Cell:
    return number(x, F.atanh, lambda a: [(F.abs(a) >= 1, NUM)])


def SIN(x) -> Cell:
    return number(x, F.sin)


def COS(x) -> Cell:
    return number(x, F.cos)


def TAN(x) -> Cell:
    return number(x, F.tan, lambda a: [(F.abs(a) >= 134217728, NUM)])


def SINH(x) -> Cell:
    return checked(number(x, F.sinh))


def COSH(x) -> Cell:
    return checked(number(x, F.cosh))


def TANH(x) -> Cell:
    return number(x, F.tanh)


def COT(x) -> Cell:
    return number(x, lambda a: 1 / F.tan(a), lambda a: [(F.tan(a) == 0, DIV0)])


def COTH(x) -> Cell:
    return number(x, lambda a: 1 / F.tanh(a), lambda a: [(a == 0, DIV0)])


def CSC(x) -> Cell:
    return number(x, lambda a: 1 / F.sin(a), lambda a: [(F.sin(a) == 0, DIV0)])


def CSCH(x) -> Cell:
    return number(x, lambda a: 1 / F.sinh(a), lambda a: [(a == 0, DIV0)])


def SEC(x) -> Cell:
    return number(x, lambda a: 1 / F.cos(a))


def SECH(x) -> Cell:
    return number(x, lambda a: 1 / F.cosh(a))


def CEILING(x, significance=1) -> Cell:
    return arithmetic(x, significance, lambda a, s: F.when(s == 0, 0.0).otherwise(F.ceil(a / F.when(s == 0, 1.0).otherwise(s)) * s), lambda a, s: [((s < 0) & (a > 0), NUM)])


def FLOOR(x, significance=1) -> Cell:
    return arithmetic(x, significance, lambda a, s: F.when(a == 0, 0.0).otherwise(F.floor(a / F.when(s == 0, 1.0).otherwise(s)) * s), lambda a, s: [((a > 0) & (s < 0), NUM), ((s == 0) & (a != 0), DIV0)])


def _mathstep(x, significance, mode, away, toward) -> Cell:
    a, s, m = to_number(x), to_number(significance), to_number(mode)
    step = F.when(s.value == 0, 1.0).otherwise(F.abs(s.value))
    ratio = a.value / step
    value = F.when((a.value < 0) & (m.value != 0), toward(ratio)).otherwise(away(ratio)) * step
    return made("num", F.when(s.value == 0, 0.0).otherwise(value), a, s, m)


def CEILING_MATH(x, significance=1, mode=0) -> Cell:
    """Up to a multiple; negative numbers go away from zero with a mode other than 0."""
    return _mathstep(x, significance, mode, F.ceil, F.floor)


def FLOOR_MATH(x, significance=1, mode=0) -> Cell:
    """Down to a multiple; negative numbers go toward zero with a mode other than 0."""
    return _mathstep(x, significance, mode, F.floor, F.ceil)


def _parity(x, want_odd: bool) -> Cell:
    def f(a):
        up = F.ceil(a).cast("double")
        wrong = ~_odd(up) if want_odd else _odd(up)
        return F.when(wrong, up + F.when(up < 0, -1.0).otherwise(1.0)).otherwise(up)

    return number(x, f)


def EVEN(x) -> Cell:
    """The next whole number up, moved away from zero if it is odd."""
    return _parity(x, False)


def ODD(x) -> Cell:
    return _parity(x, True)


def MROUND(x, multiple) -> Cell:
    def f(a, m):
        safe = F.when(m == 0, 1.0).otherwise(m)
        return F.when((a == 0) | (m == 0), 0.0).otherwise(F.floor(a / safe + 0.5) * safe)

    return arithmetic(x, multiple, f, lambda a, m: [((a * m) < 0, NUM)])


def _product(low: Column, high: Column, step: int = 1) -> Column:
    span = F.when(low <= high, F.sequence(low.cast("int"), high.cast("int"), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(span, F.lit(1.0), lambda acc, i: acc * i.cast("double"))


def FACT(x) -> Cell:
    return number(x, lambda a: _product(F.lit(1), F.floor(a)), lambda a: [((a < 0) | (a >= 171), NUM)])


def FACTDOUBLE(x) -> Cell:
    return checked(number(x, lambda a: _product(F.when(_odd(F.floor(a)), 1).otherwise(2), F.floor(a), 2), lambda a: [((a < -1) | (a > 300), NUM)]))


def _choose(n: Column, k: Column) -> Column:
    least = F.least(k, n - k)
    return F.round(F.aggregate(F.when(least >= 1, F.sequence(F.lit(1), least.cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(1.0), lambda acc, i: acc * (n - least + i) / i))


def COMBIN(n, k) -> Cell:
    return checked(arithmetic(n, k, lambda a, b: _choose(F.floor(a), F.floor(b)), lambda a, b: [((a < 0) | (b < 0) | (F.floor(a) < F.floor(b)) | (a >= 2147483647), NUM)]))


def COMBINA(n, k) -> Cell:
    return checked(arithmetic(n, k, lambda a, b: F.when((F.floor(a) == 0) & (F.floor(b) == 0), 1.0).otherwise(_choose(F.floor(a) + F.floor(b) - 1, F.floor(b))), lambda a, b: [((a < 0) | (b < 0), NUM)]))


# Roman numerals by value.
_ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def ROMAN(x, form=0) -> Cell:
    """Classic numerals of 0 to 3999; form must be 0 to 4 and has no effect."""
    a, f = to_number(x), to_number(form)
    n = F.floor(a.value).cast("int")
    parts, rest = [], n
    for value, sign in _ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    bad = [((a.value < 0) | (a.value >= 4000) | (f.value < 0) | (f.value > 4), VALUE)]
    return made("text", F.concat(*parts), a, f, bad=bad)


def ARABIC(x) -> Cell:
    """The number of a Roman numeral, with a minus sign perhaps."""
    t = to_text(x)
    up = F.upper(F.trim(t.value))
    digits = F.transform(F.split(F.regexp_replace(up, "^-", ""), ""), lambda c: F.coalesce(*[F.when(c == s, v) for v, s in _ROMAN if len(s) == 1], F.lit(0)))
    total = F.aggregate(
        F.reverse(digits), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda acc, d: F.struct(F.when(d < acc["last"], acc["sum"] - d).otherwise(acc["sum"] + d).alias("sum"), F.greatest(d, acc["last"]).alias("last")),
        lambda acc: acc["sum"].cast("double"),
    )
    bad = [((F.length(t.value) > 255) | ~up.rlike("^-?[MDCLXVI]*$"), VALUE), (up == "-", NUM)]
    return made("num", F.when(up.startswith("-"), -total).otherwise(total), t, bad=bad)


def BASE(x, radix, least=0) -> Cell:
    a, r, m = to_number(x), to_number(radix), to_number(least)
    wrong = (a.value < 0) | (a.value >= 2**53) | (r.value < 2) | (r.value >= 37) | (m.value < 0) | (m.value > 255)
    digits = F.conv(F.floor(a.value).cast("bigint").cast("string"), 10, 36)
    # conv takes a constant radix only: one branch for each.
    for base in range(2, 37):
        digits = F.when(F.floor(r.value) == base, F.conv(F.floor(a.value).cast("bigint").cast("string"), 10, base)).otherwise(digits)
    return made("text", F.lpad(digits, F.greatest(F.length(digits), F.floor(m.value).cast("int")), F.lit("0")), a, r, m, bad=[(wrong, NUM)])


def DECIMAL(x, radix) -> Cell:
    t, r = to_text(x), to_number(radix)
    digits = F.transform(F.split(F.upper(F.trim(t.value)), ""), lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1)
    wrong = (r.value < 2) | (r.value >= 37) | F.exists(digits, lambda d: (d < 0) | (d >= F.floor(r.value)))
    value = F.aggregate(digits, F.lit(0.0), lambda acc, d: acc * F.floor(r.value) + d)
    return made("num", value, t, r, bad=[(F.octet_length(t.value) > 255, VALUE), (wrong, NUM)])


def GCD(*xs) -> Cell:
    """Greatest common divisor by Euclid's steps over the arguments."""

    def gcd(a: Column, b: Column) -> Column:
        start = F.struct(a.alias("x"), b.alias("y"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1).cast("bigint")).otherwise(s["y"])).alias("y"))))["x"]

    cells = [to_number(x) for x in xs]
    value = F.floor(cells[0].value).cast("bigint")
    for c in cells[1:]:
        value = gcd(value, F.floor(c.value).cast("bigint"))
    return made("num", value.cast("double"), *cells, bad=[((c.value < 0) | (c.value >= 2**53), NUM) for c in cells])


def LCM(*xs) -> Cell:
    out = to_number(xs[0])
    out = made("num", F.floor(out.value).cast("double"), out, bad=[((out.value < 0) | (out.value >= 2**53), NUM)])
    for x in xs[1:]:
        g = GCD(out, x)
        b = to_number(x)
        out = made("num", F.when(g.value == 0, 0.0).otherwise(out.value * F.floor(b.value) / F.when(g.value == 0, 1.0).otherwise(g.value)), out, b, g)
    return out


def MULTINOMIAL(*xs) -> Cell:
    cells = [to_number(x) for x in xs]
    total = cells[0].value
    for c in cells[1:]:
        total = total + c.value
    below = None
    for c in cells:
        below = FACT(c).value if below is None else below * FACT(c).value
    return checked(made("num", FACT(Cell("num", total)).value / below, *cells, bad=[(c.value < 0, NUM) for c in cells]))


def SERIESSUM(x, n, m, coefficients: list) -> Cell:
    """Sum of c_i * x^(n + i * m)."""
    a, low, step = to_number(x), to_number(n), to_number(m)
    cells = [to_number(c) for c in coefficients]
    total = F.lit(0.0)
    for i, c in enumerate(cells):
        total = total + c.value * F.pow(a.value, low.value + i * step.value)
    return checked(made("num", total, a, low, step, *cells))


def RAND(seed: int | None = None) -> Cell:
    return Cell("num", F.rand() if seed is None else F.rand(seed))


def RANDBETWEEN(low, high, seed: int | None = None) -> Cell:
    draw = F.rand() if seed is None else F.rand(seed)
    return arithmetic(low, high, lambda a, b: F.ceil(a) + F.round(draw * (F.ceil(b) - F.ceil(a))), lambda a, b: [(a > b, NUM)])


def PRODUCT(*xs) -> Cell:
    cells = [to_number(x) for x in xs]
    value = cells[0].value
    for c in cells[1:]:
        value = value * c.value
    return made("num", value, *cells)


def SUM(*xs) -> Cell:
    """Of single cells in one row; over rows see quillgrid.operators.aggregates."""
    cells = [to_number(x) for x in xs]
    value = cells[0].value
    for c in cells[1:]:
        value = value + c.value
    return made("num", value, *cells)


def FISHER(x) -> Cell:
    return number(x, lambda a: 0.5 * F.ln((1 + a) / (1 - a)), lambda a: [((a <= -1) | (a >= 1), NUM)])


def BINOM_DIST(k, n, p, cumulative) -> Cell:
    """Probability of k successes in n trials, or of at most k."""
    a, b, q, c = to_number(k), to_number(n), to_number(p), cell(cumulative)
    kk, nn = F.floor(a.value), F.floor(b.value)

    def mass(i):
        return _choose(nn, i) * F.pow(q.value, i) * F.pow(1 - q.value, nn - i)

    upto = F.aggregate(F.sequence(F.lit(0), F.greatest(kk, F.lit(0)).cast("int")), F.lit(0.0), lambda acc, i: acc + mass(i.cast("double")))
    flag = F.coalesce(c.value.cast("boolean"), F.lit(False))
    bad = [((q.value < 0) | (q.value > 1) | (kk < 0) | (kk > nn), NUM)]
    return made("num", F.when(flag, upto).otherwise(mass(kk)), a, b, q, c, bad=bad)
