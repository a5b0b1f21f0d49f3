"""Logical, information, reference and financial functions over cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.cells import ERRORS, NA, NUM, REF, VALUE, Cell, boolean, cell, error, first_error, made, num, text, to_bool, to_number, to_text


def _same_kind(cells: list[Cell]) -> list[Cell]:
    kinds = {c.kind for c in cells if c.kind != "blank"}
    return [c if c.kind != "blank" else Cell(next(iter(kinds), "num"), F.lit(None), c.error) for c in cells] if len(kinds) <= 1 else [to_text(c) for c in cells]


def IF(test, then, other=False) -> Cell:
    """A branch's error counts only where the branch is taken; branches of different kinds become text."""
    t = to_bool(test)
    a, b = _same_kind([cell(then), cell(other)])
    branch = None
    if a.error is not None or b.error is not None:
        none = F.lit(None).cast("string")
        branch = F.when(t.value, a.error if a.error is not None else none).otherwise(b.error if b.error is not None else none)
    errors = [e for e in (t.error, branch) if e is not None]
    found = F.coalesce(*errors) if errors else None
    value = F.when(t.value, a.value).otherwise(b.value)
    return Cell(a.kind if a.kind != "blank" else b.kind, value if found is None else F.when(found.isNull(), value), found)


def AND(*xs) -> Cell:
    cells = [to_bool(x) for x in xs]
    value = cells[0].value
    for c in cells[1:]:
        value = value & c.value
    return made("bool", value, *cells)


def OR(*xs) -> Cell:
    cells = [to_bool(x) for x in xs]
    value = cells[0].value
    for c in cells[1:]:
        value = value | c.value
    return made("bool", value, *cells)


def NOT(x) -> Cell:
    b = to_bool(x)
    return made("bool", ~b.value, b)


def TRUE() -> Cell:
    return boolean(True)


def FALSE() -> Cell:
    return boolean(False)


def IFERROR(x, other) -> Cell:
    c = cell(x)
    if c.error is None:
        return c
    a, b = _same_kind([c, cell(other)])
    found = F.when(c.error.isNotNull(), b.error) if b.error is not None else None
    value = F.when(c.error.isNull(), a.value).otherwise(b.value)
    return Cell(a.kind, value, found)


def _flag(value) -> Cell:
    return Cell("bool", F.coalesce(value, F.lit(False)))


def _fails(c: Cell):
    return c.error.isNotNull() if c.error is not None else F.lit(False)


def ISBLANK(x) -> Cell:
    c = cell(x)
    return _flag(c.value.isNull() & ~_fails(c))


def ISNUMBER(x) -> Cell:
    c = cell(x)
    return _flag(c.value.isNotNull() & ~_fails(c) if c.kind == "num" else F.lit(False))


def ISTEXT(x) -> Cell:
    c = cell(x)
    return _flag(c.value.isNotNull() & ~_fails(c) if c.kind == "text" else F.lit(False))


def ISNONTEXT(x) -> Cell:
    return _flag(~ISTEXT(x).value)


def ISLOGICAL(x) -> Cell:
    c = cell(x)
    return _flag(c.value.isNotNull() & ~_fails(c) if c.kind == "bool" else F.lit(False))


def ISERROR(x) -> Cell:
    return _flag(_fails(cell(x)))


def ISERR(x) -> Cell:
    c = cell(x)
    return _flag(c.error != NA if c.error is not None else F.lit(False))


def ISNA(x) -> Cell:
    c = cell(x)
    return _flag(c.error == NA if c.error is not None else F.lit(False))


def _parity(x, odd: int) -> Cell:
    c = cell(x)
    if c.kind == "bool":
        return made("bool", F.lit(None).cast("boolean"), c, bad=[(F.lit(True), VALUE)])
    n = to_number(c)
    whole = F.signum(n.value) * F.floor(F.abs(n.value))
    return made("bool", F.abs(whole) % 2 == odd, n, bad=[(c.value.isNull(), NA)])


def ISEVEN(x) -> Cell:
    return _parity(x, 0)


def ISODD(x) -> Cell:
    return _parity(x, 1)


def ISREF(x) -> Cell:
    """Whether the argument is a range of cells (quillgrid.operators.ranges.Range) and not a value."""
    return Cell("bool", F.lit(hasattr(x, "first_row")))


def N(x) -> Cell:
    c = cell(x)
    return to_number(c) if c.kind in ("num", "bool") else Cell("num", F.lit(0.0), c.error)


def NA_VALUE() -> Cell:
    return error(NA)


def TYPE(x) -> Cell:
    """1 for numbers and blanks, 2 text, 4 booleans, 16 errors."""
    c = cell(x)
    code = F.lit({"text": 2.0, "bool": 4.0}.get(c.kind, 1.0))
    return Cell("num", F.when(_fails(c), 16.0).when(c.value.isNull(), 1.0).otherwise(code))


def ERROR_TYPE(x) -> Cell:
    c = cell(x)
    if c.error is None:
        return error(NA)
    place = F.array_position(F.array(*[F.lit(e) for e in ERRORS]), c.error)
    return Cell("num", F.when(c.error.isNotNull(), place.cast("double")), F.when(c.error.isNull(), F.lit(NA)))


def CHOOSE(index, *xs) -> Cell:
    i, cells = to_number(index), _same_kind([cell(x) for x in xs])
    at = F.floor(i.value)
    value = err = None
    none = F.lit(None).cast("string")
    for k, c in enumerate(cells, 1):
        value = F.when(at == k, c.value) if value is None else value.when(at == k, c.value)
        err = F.when(at == k, c.error if c.error is not None else none) if err is None else err.when(at == k, c.error if c.error is not None else none)
    out = made(cells[0].kind, value, i, bad=[((at < 1) | (at > len(cells)), VALUE)])
    return Cell(out.kind, out.value, first_error(out, Cell("num", value, err)))


def column_letters(n) -> Cell:
    """Letters of a column number: 1 is A, 27 is AA."""
    k = to_number(n)
    m = F.floor(k.value).cast("int")
    one = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (m - 1) % 26 + 1, F.lit(1))
    rest = F.floor((m - 1) / 26).cast("int")
    two = F.when(rest > 0, F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (rest - 1) % 26 + 1, F.lit(1))).otherwise("")
    top = F.floor((rest - 1) / 26).cast("int")
    three = F.when(top > 0, F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (top - 1) % 26 + 1, F.lit(1))).otherwise("")
    return made("text", F.concat(three, two, one), k, bad=[((k.value < 1) | (k.value > 16384), VALUE)])


def ADDRESS(row, column, absolute: int = 1, a1: bool = True, sheet: str | None = None) -> Cell:
    """Reference text; absolute 1 both, 2 row only, 3 column only, 4 none."""
    r, c = to_number(row), to_number(column)
    rows, cols = F.floor(r.value).cast("bigint").cast("string"), F.floor(c.value).cast("bigint").cast("string")
    if a1:
        out = F.concat(F.lit("$" if absolute in (1, 3) else ""), column_letters(c).value, F.lit("$" if absolute in (1, 2) else ""), rows)
    else:
        out = F.concat(F.lit("R"), rows if absolute in (1, 2) else F.concat(F.lit("["), rows, F.lit("]")), F.lit("C"), cols if absolute in (1, 3) else F.concat(F.lit("["), cols, F.lit("]")))
    if sheet:
        out = F.concat(F.lit(f"{sheet}!"), out)
    bad = [((r.value < 1) | (c.value < 1) | (c.value > 16384) | F.lit(absolute not in (1, 2, 3, 4)), VALUE)]
    return made("text", out, r, c, bad=bad)


def HYPERLINK(link, name=None) -> Cell:
    return cell(link) if name is None else cell(name)


def INFO(kind: str) -> Cell:
    """Facts about the environment that make sense here; others are #N/A."""
    known = {"recalc": text("Automatic"), "system": text("pcdos"), "release": text("16.0"), "numfile": num(1), "osversion": text("Spark")}
    return known.get(kind.lower(), error(NA) if kind.lower() in ("directory", "origin") else error(VALUE))


def FORMULATEXT(formula) -> Cell:
    c = cell(formula)
    return made("text", c.value, c, bad=[(c.value.isNull(), NA)])


def INDEX_OF(cells: list, position) -> Cell:
    """INDEX over cells of one row: 1-based; beyond them #REF!, under 1 #VALUE!."""
    i, own = to_number(position), _same_kind([cell(c) for c in cells])
    at = F.floor(i.value).cast("int")
    return made(own[0].kind, F.get(F.array(*[c.value for c in own]), at - 1), i, bad=[(at < 1, VALUE), (at > len(own), REF)])


def _annuity(rate, nper, kind):
    growth = F.pow(1 + rate, nper)
    return growth, (1 + rate * kind) * (growth - 1) / F.when(rate == 0, 1.0).otherwise(rate)


def FV(rate, nper, pmt, pv=0, kind=0) -> Cell:
    r, n, p, v, k = (to_number(x) for x in (rate, nper, pmt, pv, kind))
    begin = F.when(k.value != 0, 1.0).otherwise(0.0)
    growth, factor = _annuity(r.value, n.value, begin)
    value = F.when(r.value == 0, -(v.value + p.value * n.value)).otherwise(-(v.value * growth + p.value * factor))
    return made("num", value, r, n, p, v, k)


def PMT(rate, nper, pv, fv=0, kind=0) -> Cell:
    r, n, v, f, k = (to_number(x) for x in (rate, nper, pv, fv, kind))
    begin = F.when(k.value != 0, 1.0).otherwise(0.0)
    growth, factor = _annuity(r.value, n.value, begin)
    value = F.when(r.value == 0, -(v.value + f.value) / n.value).otherwise(-(v.value * growth + f.value) / factor)
    return made("num", value, r, n, v, f, k, bad=[((n.value == 0) | (r.value <= -1), NUM)])


def IPMT(rate, per, nper, pv, fv=0, kind=0) -> Cell:
    """Interest part of payment `per`."""
    r, t, n, v, f, k = (to_number(x) for x in (rate, per, nper, pv, fv, kind))
    wrong = (n.value <= 0) | (r.value <= -1) | (t.value < 1) | (t.value > F.ceil(n.value))
    safe = F.when(wrong, 1.0).otherwise(n.value)
    pay = PMT(Cell("num", F.when(wrong, 0.0).otherwise(r.value)), Cell("num", safe), v, f, k)
    held = FV(r, Cell("num", t.value - 1), pay, v, k)
    interest = held.value * r.value
    value = F.when(k.value != 0, F.when(t.value == 1, 0.0).otherwise(interest / (1 + r.value))).otherwise(interest)
    return made("num", value, r, t, n, v, f, k, bad=[(wrong, NUM)])
