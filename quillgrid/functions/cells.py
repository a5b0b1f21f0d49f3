"""Cells: a value column with its error column, and the coercions between kinds.

A cell's kind is `num`, `text`, `bool` or `blank`. NULL value and NULL error is a blank. `error` is None where no error
can occur, so plain arithmetic over typed columns stays a bare Catalyst expression that pushes down and compiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL, DIV0, VALUE, REF, NAME, NUM, NA = "#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"
ERRORS = (NULL, DIV0, VALUE, REF, NAME, NUM, NA)
_NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity|nan)$"


@dataclass(frozen=True)
class Cell:
    """A typed expression: value and error columns."""

    kind: str
    value: Column
    error: Column | None = None

    def shown(self) -> Column:
        """The error code, or else the value as text."""
        text = to_text(self)
        return F.coalesce(text.error, text.value) if text.error is not None else text.value

    def __add__(self, other):
        return arithmetic(self, other, lambda a, b: a + b)

    def __sub__(self, other):
        return arithmetic(self, other, lambda a, b: a - b)

    def __mul__(self, other):
        return arithmetic(self, other, lambda a, b: a * b)

    def __truediv__(self, other):
        return arithmetic(self, other, lambda a, b: a / b, lambda a, b: [(b == 0, DIV0)])

    def __pow__(self, other):
        out = arithmetic(self, other, F.pow)
        return checked(out)

    def __neg__(self):
        return number(self, lambda x: -x)

    def __and__(self, other):
        """The & operator: both as text, joined."""
        a, b = to_text(self), to_text(cell(other))
        return made("text", F.concat(a.value, b.value), a, b)

    def compare(self, op: str, other) -> Cell:
        return compare(op, self, cell(other))


def num(value) -> Cell:
    """A number cell of a column, column name or Python number."""
    return Cell("num", (F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(float(value))).cast("double"))


def text(value) -> Cell:
    """A text cell of a column or a Python string."""
    return Cell("text", value if isinstance(value, Column) else F.lit(value))


def boolean(value) -> Cell:
    return Cell("bool", value if isinstance(value, Column) else F.lit(bool(value)))


def blank() -> Cell:
    return Cell("blank", F.lit(None).cast("double"))


def error(code: str) -> Cell:
    return Cell("num", F.lit(None).cast("double"), F.lit(code))


def cell(value) -> Cell:
    """Any of the above, by the Python type: bool, number, string, None, or a cell itself."""
    if isinstance(value, Cell):
        return value
    if value is None:
        return blank()
    if isinstance(value, bool):
        return boolean(value)
    return text(value) if isinstance(value, str) else num(value)


def first_error(*cells: Cell) -> Column | None:
    """The error of the leftmost cell that has one."""
    found = [c.error for c in cells if c.error is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def made(kind: str, value: Column, *of: Cell, bad: list[tuple[Column, str]] = ()) -> Cell:
    """A cell computed from others: their errors first, then the first condition that holds; the value is NULL then."""
    wrong = None
    for condition, code in bad:
        wrong = F.when(condition, F.lit(code)) if wrong is None else wrong.when(condition, F.lit(code))
    found = first_error(*of)
    if wrong is not None:
        found = wrong if found is None else F.coalesce(found, wrong)
    return Cell(kind, value if found is None else F.when(found.isNull(), value), found)


def checked(c: Cell) -> Cell:
    """#NUM! for NaN and infinities."""
    return made("num", c.value, c, bad=[(F.isnan(c.value) | (F.abs(c.value) == float("inf")), NUM)])


def to_number(c) -> Cell:
    """Blank 0, TRUE 1, "" 0; text is trimmed and must be a number, else #VALUE!."""
    c = cell(c)
    if c.kind == "num":
        return Cell("num", F.coalesce(c.value, F.lit(0.0)), c.error)
    if c.kind == "blank":
        return num(0)
    if c.kind == "bool":
        return Cell("num", F.coalesce(c.value.cast("double"), F.lit(0.0)), c.error)
    plain = F.trim(F.coalesce(c.value, F.lit("")))
    ok = (plain == "") | F.lower(plain).rlike(_NUMBER)
    value = F.when(plain == "", F.lit(0.0)).when(ok, plain.try_cast("double"))
    return made("num", value, c, bad=[(~ok, VALUE)])


def number_text(x: Column) -> Column:
    """A number without exponent and without a needless fraction: 1.0 is 1, 1e20 is 100000000000000000000."""
    whole = (F.floor(x).cast("double") == x) & (F.abs(x) < 1e18)
    plain = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,15)").cast("string"), r"0+$", ""), r"\.$", "")
    large = F.regexp_replace(F.format_number(x, 0), ",", "")
    # Shortest digits that read back as the number, where they have no exponent.
    short = x.cast("string")
    return F.when(whole, x.cast("bigint").cast("string")).when(F.abs(x) >= 1e18, large).when(~short.contains("E"), short).otherwise(plain)


def to_text(c) -> Cell:
    """Blank "", TRUE/FALSE, numbers as number_text."""
    c = cell(c)
    if c.kind == "blank":
        return text("")
    if c.kind == "text":
        return Cell("text", F.coalesce(c.value, F.lit("")), c.error)
    if c.kind == "bool":
        return Cell("text", F.when(c.value, "TRUE").when(~c.value, "FALSE").otherwise(""), c.error)
    return Cell("text", F.coalesce(number_text(c.value), F.lit("")), c.error)


def to_bool(c) -> Cell:
    """Blank FALSE, numbers by being other than 0, text only TRUE or FALSE, else #VALUE!."""
    c = cell(c)
    if c.kind == "blank":
        return boolean(False)
    if c.kind == "bool":
        return Cell("bool", F.coalesce(c.value, F.lit(False)), c.error)
    if c.kind == "num":
        return Cell("bool", F.coalesce(c.value != 0, F.lit(False)), c.error)
    upper = F.upper(c.value)
    return made("bool", F.coalesce(upper == "TRUE", F.lit(False)), c, bad=[(~F.coalesce(upper.isin("TRUE", "FALSE"), F.lit(True)), VALUE)])


def number(c, f, bad=None) -> Cell:
    """f over c as a number; bad(x) gives (condition, code) pairs."""
    x = to_number(c)
    return made("num", f(x.value).cast("double"), x, bad=bad(x.value) if bad else ())


def arithmetic(a, b, f, bad=None) -> Cell:
    """f over two cells as numbers; bad(x, y) gives (condition, code) pairs, checked before f runs."""
    x, y = to_number(a), to_number(b)
    return made("num", f(x.value, y.value).cast("double"), x, y, bad=bad(x.value, y.value) if bad else ())


_RANK = {"blank": 0, "num": 1, "text": 2, "bool": 3}


def compare(op: str, a, b) -> Cell:
    """=, <>, <, <=, >, >= of typed values. Kinds rank blank < number < text < boolean, so values of different kinds are
    never equal; text compares by its upper case. A NULL value ranks as a blank."""
    a, b = cell(a), cell(b)

    def rank(c: Cell) -> Column:
        return F.when(c.value.isNull(), 0).otherwise(_RANK[c.kind])

    x, y = (F.upper(c.value) if c.kind == "text" else c.value for c in (a, b))
    order = F.when(rank(a) < rank(b), -1).when(rank(a) > rank(b), 1)
    if a.kind == b.kind and a.kind != "blank":
        order = order.when(a.value.isNull(), 0).when(x < y, -1).when(x > y, 1)
    order = order.otherwise(0)
    tests = {"=": order == 0, "<>": order != 0, "<": order < 0, "<=": order <= 0, ">": order > 0, ">=": order >= 0}
    return made("bool", tests[op], a, b)
