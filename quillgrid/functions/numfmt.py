"""Number formats as text columns: a format code is read once, into a column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.cells import number_text
from quillgrid.functions.dates import to_date
from quillgrid.functions.mathematics import half_away

# Built-in format numbers.
BUILTIN = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00",
    5: "$#,##0_);($#,##0)", 6: "$#,##0_);[Red]($#,##0)", 7: "$#,##0.00_);($#,##0.00)", 8: "$#,##0.00_);[Red]($#,##0.00)",
    9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm-dd-yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss",
    22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    41: '_(* #,##0_);_(* (#,##0);_(* "-"_);_(@_)', 42: '_($* #,##0_);_($* (#,##0);_($* "-"_);_(@_)',
    43: '_(* #,##0.00_);_(* (#,##0.00);_(* "-"??_);_(@_)', 44: '_($* #,##0.00_);_($* (#,##0.00);_($* "-"??_);_(@_)',
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
# Formats of financial models by name.
FINANCE = {
    "bps1": '0.0\\ "bps"', "bps2": '0.00\\ "bps"', "usd_millions1": '[$$-409]#,##0.0,,\\ "mm"', "usd_millions2": '[$$-409]#,##0.00,,\\ "mm"',
    "usd_billions2": '[$$-409]#,##0.00,,,\\ "bn"', "pct1_signed": "+0.0%;-0.0%;0.0%", "pct2_signed": "+0.00%;-0.00%;0.00%", "multiple2": "0.00x", "integer_thousands": "#,##0",
}
# The format of a measure's kind.
MEASURES = {"currency": "usd_millions2", "percentage": "pct2_signed", "bps": "bps1", "multiple": "multiple2", "number": "integer_thousands"}


def is_date(code: str) -> bool:
    """Whether a code formats dates or times: a date letter outside quotes and brackets."""
    plain = re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code)
    return plain.lower() != "general" and bool(re.search(r"[ymdhs]", plain, re.IGNORECASE)) and "E+" not in plain


def _fixed(x: Column, places: int, commas: bool, shift: int = 0) -> Column:
    """x times 10^shift (of %, and of commas that scale) to that many places, half away from zero. One factor moves the point
    and the last place together: 725 / 10000 as 0.0% is rounded from 72.5, where 725 / 10000 * 100 * 10 is just under it."""
    power = shift + places
    if shift and places < 15:
        moved = x * 10.0**power if power >= 0 else x / 10.0**-power
        rounded = half_away(moved, F.lit(0.0)) / 10.0**places
    else:
        rounded = half_away(x * 10.0**shift if shift else x, F.lit(float(places)))
    shown = F.format_number(rounded, places)
    return shown if commas else F.replace(shown, F.lit(","), F.lit(""))


def _number(x: Column, code: str) -> Column:
    """One section of a numeric code over a number that is not negative."""
    tokens = re.findall(r'"[^"]*"|\\.|_.|\*.|\[[^\]]*\]|E[+-]0+|[0#?.,]+|%|.', code)
    literal = lambda t: F.lit(t[1:-1] if t[0] == '"' else t[1:] if t[0] == "\\" else " " if t[0] == "_" else t)
    body = next((t for t in tokens if re.fullmatch(r"[0#?.,]+", t) and re.search(r"[0#?]", t)), None)
    exponent = next((t for t in tokens if re.match(r"E[+-]0+", t)), None)
    shift = 2 * tokens.count("%")
    out: list[Column] = []
    if body:
        trimmed = body.rstrip(",")
        shift -= 3 * (len(body) - len(trimmed))
        whole, _, part = trimmed.partition(".")
        least, places = part.count("0"), len(part)
        digits = whole.count("0")
    for t in tokens:
        if t == body:
            if exponent:
                y = x * 10.0**shift
                power = F.when(y == 0, 0.0).otherwise(F.floor(F.log10(F.when(y == 0, 1.0).otherwise(F.abs(y)))))
                shown = _fixed(y / F.pow(F.lit(10.0), power), places, False)
                sign = F.when(power < 0, "-").otherwise("+" if exponent[1] == "+" else "")
                shown = F.concat(shown, F.lit("E"), sign, F.lpad(F.abs(power).cast("int").cast("string"), len(exponent) - 2, "0"))
            else:
                shown = _fixed(x, places, "," in whole, shift)
                if least < places:  # optional digits at the end
                    shown = F.regexp_replace(shown, rf"(\.\d{{{least}}}\d*?)0+$", "$1")
                    shown = F.regexp_replace(shown, r"\.$", "") if least == 0 else shown
                if digits == 0:
                    shown = F.regexp_replace(shown, r"^0(?=\.|$)", "")
                elif digits > 1:
                    left = F.substring_index(shown, ".", 1)
                    rest = F.expr("''") if places == 0 else F.concat(F.lit("."), F.substring_index(shown, ".", -1))
                    shown = F.concat(F.lpad(left, F.greatest(F.length(left), F.lit(digits)), F.lit("0")), rest)
            out.append(shown)
        elif t.startswith("[$"):  # a currency sign, with a locale perhaps
            out.append(F.lit(t[2:-1].partition("-")[0]))
        elif t == exponent or t[0] in "*[" or re.fullmatch(r"[0#?.,]+", t):
            continue
        else:
            out.append(literal(t))
    return F.concat(*out) if out else F.lit("")


_PARTS = [
    ("yyyy", "yyyy"), ("yy", "yy"), ("mmmm", "MMMM"), ("mmm", "MMM"), ("dddd", "EEEE"), ("ddd", "EEE"), ("dd", "dd"), ("d", "d"),
    ("hh", "HH"), ("h", "H"), ("ss", "ss"), ("s", "s"),
]


def _date(x: Column, code: str) -> Column:
    half = "AM/PM" in code.upper()
    tokens = re.findall(r'"[^"]*"|\\.|\[h+\]|\[[^\]]*\]|AM/PM|y+|m+|d+|h+|s+|.', code, re.IGNORECASE)
    seconds = F.pmod(F.floor((x - F.floor(x)) * 86400 + 0.5), F.lit(86400))
    moment = F.timestamp_seconds(F.unix_date(to_date(x)).cast("bigint") * 86400 + seconds)
    clock = {"h": F.floor(seconds / 3600), "n": F.floor(seconds % 3600 / 60), "s": seconds % 60}
    out, last = [], ""
    for i, t in enumerate(tokens):
        low = t.lower()
        following = next((u.lower() for u in tokens[i + 1 :] if re.match("[ymdhs]", u.lower())), "")
        if low[0] == '"' or low[0] == "\\":
            out.append(F.lit(t.strip('"').lstrip("\\")))
        elif low.startswith("[h"):
            out.append(F.floor(x * 24 + 1e-9).cast("bigint").cast("string"))
            last = "h"
        elif low[0] == "[":
            continue
        elif low == "am/pm":
            out.append(F.when(seconds < 43200, "AM").otherwise("PM"))
        elif low[0] == "m" and (last == "h" or following.startswith("s")) and len(low) <= 2:
            out.append(F.lpad(clock["n"].cast("string"), 2, "0") if len(low) == 2 else clock["n"].cast("string"))
        elif low[0] == "m" and len(low) <= 2:
            out.append(F.lpad(F.month(to_date(x)).cast("string"), len(low), "0") if len(low) == 2 else F.month(to_date(x)).cast("string"))
        elif low[0] in "hs" and re.fullmatch("h+|s+", low):
            value = F.when(clock["h"] % 12 == 0, 12).otherwise(clock["h"] % 12) if half and low[0] == "h" else clock[low[0]]
            out.append(F.lpad(value.cast("string"), 2, "0") if len(low) > 1 else value.cast("string"))
        elif re.fullmatch("y+|m+|d+", low):
            pattern = dict(_PARTS).get(low, "yyyy" if low[0] == "y" else "MMMM" if low[0] == "m" else "EEEE")
            out.append(F.date_format(moment, pattern))
        else:
            out.append(F.lit(t))
        if re.match("[ymdhs]", low):
            last = low[0]
    return F.concat(*out) if out else F.lit("")


def _fraction(x: Column, places: int) -> Column:
    """Nearest fraction with a denominator of that many digits, the smallest of equally near ones: the convergents of the
    continued fraction by one fold, and where the next is too large the last step that still fits."""
    most = F.lit(float(10**places - 1))
    whole = F.floor(F.abs(x))
    rest = F.abs(x) - whole
    names = ("x", "n2", "d2", "n1", "d1", "done")
    state = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
    one, zero, no, yes = F.lit(1.0), F.lit(0.0), F.lit(False), F.lit(True)

    def let(value: Column, then) -> Column:
        """then(value), of which value is worked out once."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def step(s, _):
        near = F.round(s["x"])
        a = F.when(F.abs(s["x"] - near) < 1e-9 * near, near).otherwise(F.floor(s["x"]).cast("double"))
        return F.when(s["done"], s).otherwise(let(F.struct(a.alias("a"), (a * s["n1"] + s["n2"]).alias("n"), (a * s["d1"] + s["d2"]).alias("d")), lambda v: onward(s, v)))

    def onward(s, v):
        t = F.floor((most - s["d2"]) / F.greatest(s["d1"], one)).cast("double")
        part = F.struct((t * s["n1"] + s["n2"]).alias("n"), (t * s["d1"] + s["d2"]).alias("d"))
        left = s["x"] - v["a"]
        end = left <= 1e-9 * F.greatest(v["a"], one)
        on = state(F.when(end, zero).otherwise(1 / F.when(end, one).otherwise(left)), s["n1"], s["d1"], v["n"], v["d"], end)
        return F.when(v["d"] > most, let(part, lambda q: last(s, q))).otherwise(on)

    def last(s, q):
        off = lambda u, v: F.round(F.abs(rest - u / F.greatest(v, one)), 12)
        nearer = (q["d"] >= 1) & (off(q["n"], q["d"]) < off(s["n1"], s["d1"]))
        return state(zero, s["n2"], s["d2"], F.when(nearer, q["n"]).otherwise(s["n1"]), F.when(nearer, q["d"]).otherwise(s["d1"]), yes)

    def shown(b):
        carry = b["n"] == b["d"]
        left = (whole + F.when(carry, 1).otherwise(0)).cast("bigint").cast("string")
        part = F.concat(b["n"].cast("string"), F.lit("/"), b["d"].cast("string"))
        return F.when((b["n"] == 0) | carry, left).when(whole == 0, part).otherwise(F.concat(left, F.lit(" "), part))

    # Denominators grow at least as the Fibonacci numbers do.
    steps = F.sequence(F.lit(1), F.lit(3 + 5 * places))
    best = F.aggregate(steps, state(rest, zero, one, one, zero, no), step, lambda s: F.struct(s["n1"].cast("bigint").alias("n"), s["d1"].cast("bigint").alias("d")))
    return F.concat(F.when(x < 0, "-").otherwise(""), let(best, shown))


def format_number(x: Column, code: str | int) -> Column:
    """Text of a number by a format code or a built-in number: sections positive;negative;zero, dates, percent, exponents,
    fractions, scaling commas, literals. NULL gives NULL."""
    code = BUILTIN[code] if isinstance(code, int) else FINANCE.get(code, code)
    x = x.cast("double")
    if code in ("General", "@", ""):
        return number_text(x)
    sections = re.findall(r'(?:"[^"]*"|\\.|[^;"\\])+', code) or [code]
    if is_date(sections[0]):
        return F.when(x.isNotNull(), _date(x, sections[0]))
    if re.search(r"\?/\?", sections[0]):
        return F.when(x.isNotNull(), _fraction(x, sections[0].rpartition("/")[2].count("?")))
    positive = _number(F.abs(x), sections[0])
    negative = _number(F.abs(x), sections[1]) if len(sections) > 1 else F.concat(F.lit("-"), positive)
    zero = _number(F.abs(x), sections[2]) if len(sections) > 2 else positive
    return F.when(x < 0, negative).when(x == 0, zero).when(x > 0, positive)
