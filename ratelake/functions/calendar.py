"""Columns on dates and contract symbols: months, expiries, business days, release times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month codes of futures symbols, fixed by the exchanges.
MONTH_CODES = "FGHJKMNQUVXZ"


def third_wednesday(day: Column) -> Column:
    """The third Wednesday of a date's month."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "Wed"), 14)


def reference_period(day: Column) -> tuple[Column, Column]:
    """From the third Wednesday of a month to that of the third month after."""
    return third_wednesday(day), third_wednesday(F.add_months(F.trunc(day, "month"), 3))


def last_trade(day: Column) -> Column:
    """The day before the reference period ends."""
    return F.date_sub(reference_period(day)[1], 1)


def symbol_of(base: Column, day: Column) -> Column:
    """Base code, month code and two digits of the year."""
    return F.concat(base, F.substring(F.lit(MONTH_CODES), F.month(day), F.lit(1)), F.date_format(day, "yy"))


def symbol_month(symbol: Column, base: str) -> Column:
    """First day of the month that an outright symbol of ``base`` names, null for any other; years below 50 are of this century."""
    code = F.regexp_extract(symbol, f"^{base}([{MONTH_CODES}])[0-9]{{2}}$", 1)
    year = F.regexp_extract(symbol, f"^{base}[{MONTH_CODES}]([0-9]{{2}})$", 1)
    yy = F.try_to_number(year, F.lit("99")).cast("int")
    return F.when(code != "", F.make_date(F.when(yy < 50, 2000 + yy).otherwise(1900 + yy), F.instr(F.lit(MONTH_CODES), code), F.lit(1)))


def base_of(symbol: Column, bases: list[str]) -> Column:
    """The first code of ``bases`` that begins the symbol and leaves three characters or more."""
    found = F.lit(None).cast("string")
    for b in reversed(bases):
        found = F.when(symbol.startswith(b) & (F.length(symbol) >= len(b) + 3), b).otherwise(found)
    return found


def is_quarterly(symbol: Column, base: str) -> Column:
    return F.substring(symbol, len(base) + 1, 1).isin(*"HMUZ")


def legs(symbol: Column, base: str) -> Column:
    """Full symbols of a spread's or fly's legs: only the first is written with its base."""
    return F.transform(F.split(symbol, "-"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(base), x)))


def listed(legs_: Column, base: str) -> Column:
    """The symbol of legs that are in the order of their expiries."""
    return F.array_join(F.transform(legs_, lambda x, i: F.when(i == 0, x).otherwise(F.substring(x, F.lit(len(base) + 1), F.lit(3)))), "-")


def _weekdays_before(day: Column) -> Column:
    """Weekdays from a Monday long ago up to a date, itself left out."""
    n = F.datediff(day, F.lit("1900-01-01").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days(a: Column, b: Column) -> Column:
    """Signed number of weekdays from a to b, b left out."""
    forward = _weekdays_before(b) - _weekdays_before(a)
    # Backwards a itself counts and b does not.
    back = -(_weekdays_before(F.date_add(a, 1)) - _weekdays_before(F.date_add(b, 1)))
    return F.when(b >= a, forward).otherwise(back).cast("int")


def add_business_days(day: Column, n: int) -> Column:
    """n weekdays on; a weekend day counts as the Friday before."""
    k = _weekdays_before(F.date_add(day, 1)) - 1 + n
    return F.date_add(F.lit("1900-01-01").cast("date"), (F.floor(k / 5) * 7 + F.pmod(k, F.lit(5))).cast("int"))


def eastern(day: Column, time: str) -> Column:
    """UTC time of a New York time on a date, with its daylight saving."""
    return F.to_utc_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(time)).cast("timestamp"), "America/New_York")


def eastern_day(day: Column) -> tuple[Column, Column]:
    """First UTC time of a New York day, and that of the next."""
    return eastern(day, "00:00:00"), eastern(F.date_add(day, 1), "00:00:00")


def _is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def quarter_turn(day: Column, days: int = 5) -> Column:
    """The last weekdays of March, June and September."""
    left = _weekdays_before(F.date_add(F.last_day(day), 1)) - _weekdays_before(day)
    return F.month(day).isin(3, 6, 9) & _is_weekday(day) & (left <= days)


def year_turn(day: Column, before: int = 10, after: int = 5) -> Column:
    """The last weekdays of December and the first of January."""
    left = _weekdays_before(F.date_add(F.last_day(day), 1)) - _weekdays_before(day)
    gone = _weekdays_before(F.date_add(day, 1)) - _weekdays_before(F.trunc(day, "month"))
    return _is_weekday(day) & (((F.month(day) == 12) & (left <= before)) | ((F.month(day) == 1) & (gone <= after)))


def payroll_week(day: Column) -> Column:
    """The week, from Monday on, that has the first Friday of a month."""
    return F.dayofmonth(F.date_add(F.trunc(day, "week"), 4)) <= 7
