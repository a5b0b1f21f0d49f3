"""Text functions over cells. Positions count characters (spreadsheets that count bytes agree on ASCII)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.cells import VALUE, Cell, cell, made, text, to_bool, to_number, to_text
from quillgrid.functions.mathematics import half_away

LONGEST = 32767
# Characters of Windows-1252 at 128 to 159; a blank stands for an unassigned code.
_CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


def _int(x: Column) -> Column:
    return F.floor(x).cast("int")


def LEFT(x, n=1) -> Cell:
    t, k = to_text(x), to_number(n)
    return made("text", F.substring(t.value, F.lit(1), _int(k.value)), t, k, bad=[(k.value < 0, VALUE)])


def RIGHT(x, n=1) -> Cell:
    t, k = to_text(x), to_number(n)
    return made("text", F.right(t.value, _int(k.value)), t, k, bad=[(k.value < 0, VALUE)])


def MID(x, start, n) -> Cell:
    t, s, k = to_text(x), to_number(start), to_number(n)
    return made("text", F.substring(t.value, _int(s.value), _int(k.value)), t, s, k, bad=[((s.value < 1) | (k.value < 0), VALUE)])


def LEN(x) -> Cell:
    t = to_text(x)
    return made("num", F.length(t.value).cast("double"), t)


def LENB(x) -> Cell:
    t = to_text(x)
    return made("num", F.octet_length(t.value).cast("double"), t)


def LEFTB(x, n=1) -> Cell:
    """As many characters as fit in n bytes, other than ASCII ones taking two."""
    t, k = to_text(x), to_number(n)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def step(acc, c):
        used = acc["used"] + F.when(F.octet_length(c) == 1, 1).otherwise(2)
        return F.when(used <= k.value, F.struct(F.concat(acc["out"], c).alias("out"), used.alias("used"))).otherwise(F.struct(acc["out"].alias("out"), F.lit(1 << 30).alias("used")))

    return made("text", F.aggregate(F.split(t.value, ""), start, step)["out"], t, k, bad=[(k.value < 0, VALUE)])


def TRIM(x) -> Cell:
    """Spaces at the ends go, runs of spaces inside become one; other white space stays."""
    t = to_text(x)
    return made("text", F.trim(F.regexp_replace(t.value, " +", " ")), t)


def UPPER(x) -> Cell:
    t = to_text(x)
    return made("text", F.upper(t.value), t)


def LOWER(x) -> Cell:
    t = to_text(x)
    return made("text", F.lower(t.value), t)


def PROPER(x) -> Cell:
    """Upper case after anything that is no letter, lower case after a letter."""
    t = to_text(x)
    letters = F.split(F.lower(t.value), "")
    before = F.concat(F.array(F.lit(" ")), letters)
    out = F.transform(letters, lambda c, i: F.when(F.get(before, i).rlike(r"\p{L}"), c).otherwise(F.upper(c)))
    return made("text", F.array_join(out, ""), t)


def CONCATENATE(*xs) -> Cell:
    cells = [to_text(x) for x in xs]
    joined = F.concat(*[c.value for c in cells])
    return made("text", joined, *cells, bad=[(F.octet_length(joined) > LONGEST, VALUE)])


CONCAT = CONCATENATE


def TEXTJOIN(delimiter, ignore_empty, *xs) -> Cell:
    d, skip, cells = to_text(delimiter), to_bool(ignore_empty), [to_text(x) for x in xs]
    values = F.array(*[c.value for c in cells])
    values = F.when(skip.value, F.filter(values, lambda v: v != "")).otherwise(values)
    joined = F.reduce(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.coalesce(F.get(values, 0), F.lit("")), lambda acc, v: F.concat(acc, d.value, v))
    return made("text", joined, d, skip, *cells, bad=[(F.octet_length(joined) > LONGEST, VALUE)])


def EXACT(a, b) -> Cell:
    x, y = to_text(a), to_text(b)
    return made("bool", x.value == y.value, x, y)


def FIND(part, x, start=1) -> Cell:
    """Position of part in x from start on, with case; #VALUE! if there is none."""
    p, t, s = to_text(part), to_text(x), to_number(start)
    rest = F.substring(t.value, _int(s.value), F.length(t.value) + 1)
    found = F.instr(rest, p.value)
    at = F.when(found > 0, found + _int(s.value) - 1)
    return made("num", at.cast("double"), p, t, s, bad=[((s.value < 1) | (s.value > F.length(t.value) + 1) | (found == 0), VALUE)])


def _pattern(p: Column) -> Column:
    """Regular expression of a wildcard pattern: * and ?, with ~ before one that stands for itself."""
    quoted = F.regexp_replace(p, r"~([*?~])", "\u0001$1")
    quoted = F.regexp_replace(quoted, r"(?<!\u0001)\*", "\u0002")
    quoted = F.regexp_replace(quoted, r"(?<!\u0001)\?", "\u0003")
    quoted = F.regexp_replace(F.replace(quoted, F.lit("\u0001"), F.lit("")), r"([\\\[\](){}.^$|+*?])", r"\\$1")
    return F.concat(F.lit("(?is)"), F.replace(F.replace(quoted, F.lit("\u0002"), F.lit(".*?")), F.lit("\u0003"), F.lit(".")))


def SEARCH(part, x, start=1) -> Cell:
    """Position of the first match of part in x, without case and with wildcards * ? ~; #VALUE! if there is none."""
    p, t, s = to_text(part), to_text(x), to_number(start)
    rest = F.substring(t.value, _int(s.value), F.length(t.value) + 1)
    found = F.when(p.value == "", 1).otherwise(F.regexp_instr(rest, _pattern(p.value)))
    bad = [((s.value < 1) | (s.value > F.length(t.value) + 1) | (found == 0), VALUE)]
    return made("num", (found + _int(s.value) - 1).cast("double"), p, t, s, bad=bad)


def REPLACE(x, start, n, new) -> Cell:
    t, s, k, r = to_text(x), to_number(start), to_number(n), to_text(new)
    value = F.concat(F.substring(t.value, F.lit(1), _int(s.value) - 1), r.value, F.substring(t.value, _int(s.value) + _int(k.value), F.length(t.value) + 1))
    return made("text", value, t, s, k, r, bad=[((s.value < 1) | (k.value < 0), VALUE)])


def SUBSTITUTE(x, old, new, nth=None) -> Cell:
    """All occurrences of old, or the nth only; an empty old changes nothing."""
    t, o, r = to_text(x), to_text(old), to_text(new)
    if nth is None:
        return made("text", F.when(o.value == "", t.value).otherwise(F.replace(t.value, o.value, r.value)), t, o, r)
    k = to_number(nth)
    parts = F.split(t.value, F.concat(F.lit(r"\Q"), o.value, F.lit(r"\E")))
    many = F.size(parts) > _int(k.value)
    head = F.array_join(F.slice(parts, F.lit(1), F.greatest(_int(k.value), F.lit(1))), "\u0001")
    tail = F.array_join(F.slice(parts, F.greatest(_int(k.value), F.lit(1)) + 1, F.size(parts)), "\u0001")
    value = F.concat(F.replace(head, F.lit("\u0001"), o.value), r.value, F.replace(tail, F.lit("\u0001"), o.value))
    return made("text", F.when((o.value != "") & many, value).otherwise(t.value), t, o, r, k, bad=[(k.value < 1, VALUE)])


def REPT(x, n) -> Cell:
    t, k = to_text(x), to_number(n)
    return made("text", F.repeat(t.value, _int(k.value)), t, k, bad=[((k.value < 0) | (F.octet_length(t.value) * F.floor(k.value) > LONGEST), VALUE)])


def CHAR(n) -> Cell:
    """Character of Windows-1252 code 1 to 255."""
    k = to_number(n)
    i = _int(k.value)
    high = F.substring(F.lit(_CP1252), i - 127, F.lit(1))
    plain = F.decode(F.unhex(F.lpad(F.conv(i.cast("string"), 10, 16), 2, "0")), "ISO-8859-1")
    return made("text", F.when((i >= 128) & (i <= 159) & (high != " "), high).otherwise(plain), k, bad=[((k.value < 1) | (k.value >= 256), VALUE)])


def CODE(x) -> Cell:
    """Windows-1252 code of the first character; 63 for one that has none."""
    t = to_text(x)
    c = F.substring(t.value, 1, 1)
    at = F.instr(F.lit(_CP1252.replace(" ", "")), c)
    place = F.instr(F.lit(_CP1252), c)
    point = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("double")
    value = F.when((at > 0) & (c != " "), (place + 127).cast("double")).when(point < 256, point).otherwise(63.0)
    return made("num", value, t, bad=[(t.value == "", VALUE)])


def CLEAN(x) -> Cell:
    t = to_text(x)
    return made("text", F.regexp_replace(t.value, r"[\x00-\x1f\x80-\x9f]", ""), t)


def ASC(x) -> Cell:
    """Full-width ASCII forms and the wide space as their narrow ones."""
    t = to_text(x)
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
    return made("text", F.translate(t.value, wide, "".join(map(chr, range(0x21, 0x7F))) + " "), t)


def T(x) -> Cell:
    c = cell(x)
    return to_text(c) if c.kind == "text" else Cell("text", F.lit(""), c.error)


def _fixed(x: Column, digits: Column, commas: Column) -> Column:
    rounded = half_away(x, F.least(digits, F.lit(14.0)))
    shown = None
    # format_number takes a constant number of places only: one branch for each.
    for places in range(11):
        each = F.format_number(rounded, places)
        shown = F.when(F.greatest(_int(digits), F.lit(0)) == places, each) if shown is None else shown.when(F.greatest(_int(digits), F.lit(0)) == places, each)
    return F.when(commas, shown).otherwise(F.replace(shown, F.lit(","), F.lit("")))


def FIXED(x, digits=2, no_commas=False) -> Cell:
    """Rounded half away from zero to 0 to 10 places (fewer than 0 round left of the point)."""
    a, d, c = to_number(x), to_number(digits), to_bool(no_commas)
    return made("text", _fixed(a.value, d.value, ~c.value), a, d, c, bad=[(d.value > 10, VALUE)])


def DOLLAR(x, digits=2) -> Cell:
    """As FIXED, with a dollar sign; a negative zero has no sign."""
    a, d = to_number(x), to_number(digits)
    return made("text", F.concat(F.lit("$"), _fixed(a.value + F.lit(0.0), d.value, F.lit(True))), a, d, bad=[(d.value > 10, VALUE)])


def NUMBERVALUE(x, decimal=".", group=",") -> Cell:
    """Text with the given separators; white space is dropped, each % at the end divides by 100, empty text is 0."""
    t, d, g = to_text(x), to_text(decimal), to_text(group)
    plain = F.regexp_replace(t.value, r"\s+", "")
    percents = F.length(F.regexp_extract(plain, "(%*)$", 1))
    plain = F.regexp_replace(plain, "%+$", "")
    plain = F.replace(F.replace(plain, F.substring(g.value, 1, 1), F.lit("")), F.substring(d.value, 1, 1), F.lit("."))
    ok = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(plain == "", 0.0).when(ok, plain.try_cast("double")) / F.pow(F.lit(100.0), percents)
    return made("num", value, t, d, g, bad=[((plain != "") & ~ok, VALUE)])


def VALUE_OF(x) -> Cell:
    """VALUE: blank 0, booleans #VALUE!, text as a number, divided by 100 if it holds a %."""
    c = cell(x)
    if c.kind == "bool":
        return made("num", F.lit(None).cast("double"), c, bad=[(F.lit(True), VALUE)])
    if c.kind != "text":
        return to_number(c)
    plain = F.trim(F.regexp_replace(c.value, "[,$%]", ""))
    n = to_number(text(plain))
    return made("num", F.when(c.value.contains("%"), n.value / 100).otherwise(n.value), c, n)


def TEXT(x, code) -> Cell:
    """The short formats: 0, 0.0, 0.00 and so on, each with % or $; for full codes see quillgrid.functions.numfmt."""
    a, f = to_number(x), to_text(code)
    places = F.length(F.regexp_extract(f.value, r"\.(0+)", 1)).cast("double")
    percent = f.value.contains("%")
    shown = _fixed(F.when(percent, a.value * 100).otherwise(a.value), places, f.value.contains(","))
    return made("text", F.concat(F.when(f.value.contains("$"), "$").otherwise(""), shown, F.when(percent, "%").otherwise("")), a, f)
