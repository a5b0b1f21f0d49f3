"""Date and time functions over serial numbers of the 1900 system (1 is 1900-01-01; 60 is the day that never was)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.cells import NUM, VALUE, Cell, arithmetic, made, num, number, to_number, to_text

_LAST = 2958466  # first serial after 9999-12-31


def serial(day: Column) -> Column:
    """Serial of a date column, as double. Dates from 1900-03-01 on count the phantom leap day."""
    n = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("double")
    return F.when(n < 61, n - 1).otherwise(n)


def serial_of_timestamp(ts: Column) -> Column:
    """Serial of a timestamp column with the time of day as fraction."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return serial(ts.cast("date")) + seconds / 86400.0


def to_date(x: Column) -> Column:
    """Date of a serial; the phantom day 60 is taken for 1900-02-28."""
    days = F.floor(x).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(days < 60, days + 1).when(days == 60, 60).otherwise(days))


def _good(x: Column):
    return [((x < 0) | (x >= _LAST), NUM)]


def DATE(year, month, day) -> Cell:
    """Years under 1900 count from 1900; months and days beyond their ranges carry over."""
    y, m, d = to_number(year), to_number(month), to_number(day)
    full = F.floor(y.value) + F.when(y.value < 1900, 1900).otherwise(0)
    months = full * 12 + F.floor(m.value) - 1
    safe = (months >= 1900 * 12 - 1200) & (months < 12 * 10000) & (F.abs(d.value) < 4_000_000)
    first = F.make_date(F.floor(F.when(safe, months).otherwise(22800) / 12).cast("int"), (F.when(safe, months).otherwise(22800) % 12 + 1).cast("int"), F.lit(1))
    value = serial(F.date_add(first, F.when(safe, F.floor(d.value)).otherwise(1).cast("int") - 1))
    return made("num", value, y, m, d, bad=[(~safe | (value < 0) | (value >= _LAST), NUM)])


def YEAR(x) -> Cell:
    return number(x, lambda a: F.year(to_date(a)).cast("double"), _good)


def MONTH(x) -> Cell:
    return number(x, lambda a: F.month(to_date(a)).cast("double"), _good)


def DAY(x) -> Cell:
    return number(x, lambda a: F.dayofmonth(to_date(a)).cast("double"), _good)


def _second_of_day(a: Column) -> Column:
    return F.pmod(F.floor((a - F.floor(a)) * 86400 + 0.5), F.lit(86400))


def HOUR(x) -> Cell:
    return number(x, lambda a: F.floor(_second_of_day(a) / 3600).cast("double"), _good)


def MINUTE(x) -> Cell:
    return number(x, lambda a: F.floor(_second_of_day(a) % 3600 / 60).cast("double"), _good)


def SECOND(x) -> Cell:
    return number(x, lambda a: (_second_of_day(a) % 60).cast("double"), _good)


def TIME(hour, minute, second) -> Cell:
    h, m, s = to_number(hour), to_number(minute), to_number(second)
    wrong = F.lit(False)
    for c in (h, m, s):
        wrong = wrong | (c.value < 0) | (c.value >= 32768)
    total = (F.floor(h.value) * 3600 + F.floor(m.value) * 60 + F.floor(s.value)) / 86400.0
    return made("num", total - F.floor(total), h, m, s, bad=[(wrong, NUM)])


def DAYS(end, start) -> Cell:
    return arithmetic(end, start, lambda a, b: F.floor(a) - F.floor(b))


def _months_on(x: Column, n: Column) -> Column:
    return F.add_months(to_date(x), F.floor(n).cast("int"))


def EDATE(x, months) -> Cell:
    return arithmetic(x, months, lambda a, n: serial(_months_on(a, n)), lambda a, n: _good(a) + [(F.abs(n) > 120000, NUM)])


def EOMONTH(x, months) -> Cell:
    return arithmetic(x, months, lambda a, n: serial(F.last_day(_months_on(a, n))), lambda a, n: _good(a) + [(F.abs(n) > 120000, NUM)])


def WEEKDAY(x, kind: int = 1) -> Cell:
    """Kinds 1 (Sunday 1), 2 (Monday 1), 3 (Monday 0) and 11 to 17 (Monday to Sunday 1)."""
    if kind not in (1, 2, 3, *range(11, 18)):
        return made("num", F.lit(None).cast("double"), bad=[(F.lit(True), NUM)])
    monday = lambda a: F.pmod(F.floor(a) + 5, F.lit(7))  # noqa: E731  0 on Mondays
    if kind == 3:
        return number(x, lambda a: monday(a).cast("double"), _good)
    first = {1: 6, 2: 0}.get(kind, kind - 11)
    return number(x, lambda a: (F.pmod(monday(a) - first, F.lit(7)) + 1).cast("double"), _good)


def WEEKNUM(x, kind: int = 1) -> Cell:
    """Weeks of the year that begin on a given day (kinds 1, 2, 11 to 17), or ISO weeks (21)."""
    if kind == 21:
        return ISOWEEKNUM(x)
    if kind not in (1, 2, *range(11, 18)):
        return made("num", F.lit(None).cast("double"), bad=[(F.lit(True), NUM)])
    first = {1: 6, 2: 0}.get(kind, kind - 11)

    def f(a):
        start = serial(F.trunc(to_date(a), "year"))
        lead = F.pmod(F.floor(start) + 5 - first, F.lit(7))
        return (F.floor((F.floor(a) - start + lead) / 7) + 1).cast("double")

    return number(x, f, _good)


def ISOWEEKNUM(x) -> Cell:
    return number(x, lambda a: F.weekofyear(to_date(a)).cast("double"), _good)


def DATEVALUE(x) -> Cell:
    """Serial of a date written year-month-day or month/day/year."""
    t = to_text(x)
    plain = F.trim(t.value)
    day = F.coalesce(F.try_to_date(plain, "yyyy-M-d"), F.try_to_date(plain, "M/d/yyyy"))
    return made("num", serial(day), t, bad=[(day.isNull(), VALUE)])


def TIMEVALUE(x) -> Cell:
    """Fraction of the day of h:mm or h:mm:ss, with AM or PM perhaps."""
    t = to_text(x)
    pattern = r"(?i)^\s*(\d{1,2}):(\d{2})(?::(\d{2}))?\s*(am|pm)?\s*$"
    h, m, s = (F.regexp_extract(t.value, pattern, i).try_cast("int") for i in (1, 2, 3))
    half = F.lower(F.regexp_extract(t.value, pattern, 4))
    hours = F.when(half == "", h).otherwise(h % 12 + F.when(half == "pm", 12).otherwise(0))
    total = (hours * 3600 + m * 60 + F.coalesce(s, F.lit(0))) / 86400.0
    return made("num", total - F.floor(total), t, bad=[(~t.value.rlike(pattern) | (m > 59), VALUE)])


def DAYS360(start, end, european: bool = False) -> Cell:
    """Days between dates in a year of twelve months of 30 days."""

    def f(a, b):
        one, two = to_date(a), to_date(b)
        d1, d2 = F.dayofmonth(one), F.dayofmonth(two)
        if european:
            d1, d2 = F.least(d1, F.lit(30)), F.least(d2, F.lit(30))
        else:
            d1 = F.when(one == F.last_day(one), 30).otherwise(d1)
            d2 = F.when((d2 == 31) & (d1 >= 30), 30).otherwise(d2)
        return ((F.year(two) - F.year(one)) * 360 + (F.month(two) - F.month(one)) * 30 + (d2 - d1)).cast("double")

    return arithmetic(start, end, f, lambda a, b: _good(a) + _good(b))


def _whole_months(one: Column, two: Column) -> Column:
    return (F.year(two) - F.year(one)) * 12 + F.month(two) - F.month(one) - F.when(F.dayofmonth(two) < F.dayofmonth(one), 1).otherwise(0)


def DATEDIF(start, end, unit: str) -> Cell:
    """Whole units Y, M, D between dates, or the rest MD, YM, YD; #NUM! if start is after end."""
    unit = unit.upper()

    def f(a, b):
        one, two = to_date(a), to_date(b)
        months = _whole_months(one, two)
        if unit == "Y":
            out = F.floor(months / 12)
        elif unit == "M":
            out = months
        elif unit == "D":
            out = F.floor(b) - F.floor(a)
        elif unit == "YM":
            out = months % 12
        elif unit == "MD":
            out = F.datediff(two, F.add_months(one, months))
        else:
            out = F.datediff(two, F.add_months(one, (F.floor(months / 12) * 12).cast("int")))
        return out.cast("double")

    bad = lambda a, b: [*_good(a), *_good(b), ((a > b) | F.lit(unit not in ("Y", "M", "D", "MD", "YM", "YD")), NUM)]
    return arithmetic(start, end, f, bad)


def _weekdays_until(a: Column) -> Column:
    """Mondays to Fridays among serials 1 to a."""
    d = F.floor(a)
    weeks = F.floor((d - 2) / 7)  # serial 2 is a Monday
    return weeks * 5 + F.least(d - 2 - weeks * 7 + 1, F.lit(5))


def _holidays(holidays: list[float]) -> list[int]:
    return sorted({int(h) for h in holidays if (int(h) - 2) % 7 < 5})


def NETWORKDAYS(start, end, holidays: list[float] = ()) -> Cell:
    """Mondays to Fridays from start to end, both inside, without the holidays (serials); negative if end is first."""

    def f(a, b):
        low, high = F.least(F.floor(a), F.floor(b)), F.greatest(F.floor(a), F.floor(b))
        n = _weekdays_until(high) - _weekdays_until(low - 1)
        listed = _holidays(holidays)
        if listed:
            n = n - F.size(F.filter(F.array(*map(F.lit, listed)), lambda h: h.between(low, high)))
        return F.when(a <= b, n).otherwise(-n).cast("double")

    return arithmetic(start, end, f, lambda a, b: _good(a) + _good(b))


def WORKDAY(start, days, holidays: list[float] = ()) -> Cell:
    """The date that lies so many Mondays to Fridays after (before) start, without the holidays (serials)."""

    def f(a, n):
        count = F.signum(n) * F.floor(F.abs(n))
        base = _weekdays_until(a)
        on_weekend = F.pmod(F.floor(a) - 2, F.lit(7)) > 4
        listed = _holidays(holidays)

        def nth(index):
            """Serial of the weekday of that running number."""
            return F.floor((index - 1) / 5) * 7 + F.pmod(index - 1, F.lit(5)) + 2

        ahead, back = base + count, base + count + F.when(on_weekend, 1).otherwise(0)
        if listed:  # each holiday on the way moves the end by one; one fold, whatever their number
            ahead = F.aggregate(F.array(*map(F.lit, listed)), ahead, lambda at, h: at + F.when((F.floor(a) < h) & (h <= nth(at)), 1).otherwise(0))
            back = F.aggregate(F.array(*map(F.lit, reversed(listed))), back, lambda at, h: at - F.when((F.floor(a) > h) & (h >= nth(at)), 1).otherwise(0))
        return F.when(count > 0, nth(ahead)).when(count < 0, nth(back)).otherwise(F.floor(a)).cast("double")

    return arithmetic(start, days, f, lambda a, n: _good(a))


def YEARFRAC(start, end, basis: int = 0) -> Cell:
    """Years between dates: 0 and 4 by months of 30 days, 1 by actual days, 2 of 360 and 3 of 365."""
    if basis not in range(5):
        return made("num", F.lit(None).cast("double"), bad=[(F.lit(True), NUM)])
    if basis in (0, 4):
        a, b = to_number(start), to_number(end)
        days = DAYS360(Cell("num", F.least(a.value, b.value), a.error), Cell("num", F.greatest(a.value, b.value), b.error), basis == 4)
        return made("num", F.abs(days.value) / 360, days)

    def f(a, b):
        low, high = F.floor(F.least(a, b)), F.floor(F.greatest(a, b))
        if basis in (2, 3):
            return (high - low) / (360 if basis == 2 else 365)
        y1, y2 = F.year(to_date(low)), F.year(to_date(high))
        span = F.datediff(F.make_date(y2 + 1, F.lit(1), F.lit(1)), F.make_date(y1, F.lit(1), F.lit(1)))
        return (high - low) / (span / (y2 - y1 + 1))

    return arithmetic(start, end, f, lambda a, b: _good(a) + _good(b))


def TODAY() -> Cell:
    return Cell("num", serial(F.current_date()))


def NOW() -> Cell:
    return Cell("num", serial_of_timestamp(F.localtimestamp()))


def from_date(day) -> Cell:
    """A number cell of a date or timestamp column."""
    return num(serial((F.col(day) if isinstance(day, str) else day).cast("date")))
