"""Moments from text: a small grammar of dates and times, with the order of day and month inferred per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outagelens import fixed_values as fixed

_TIME = (
    r"(?:[ T,]+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?[ ]*([AaPp]\.?[Mm]\.?)?[ ]*(Z|[+-]\d{2}:?\d{2})?)?$"
)
#: Spellings of a date in front of the time; the letters say what the three parts are.
SPELLINGS = {
    "year first": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", "ymd"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})", "ymd"),
    "numbers": (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})", "??y"),
    "day and month name": (r"^(\d{1,2})[- ]([A-Za-z]{3,9})\.?[-, ]+(\d{4}|\d{2})", "dny"),
    "month name and day": (r"^([A-Za-z]{3,9})\.?[- ]+(\d{1,2})(?:st|nd|rd|th)?,?[- ]+(\d{4})", "ndy"),
}
UNREAD = "unread"


def _text(column: Column) -> Column:
    return F.trim(column.cast("string"))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _number(part: Column) -> Column:
    return part.try_cast("int")


def _spelled(text: Column) -> Column:
    """The name of the first spelling that a text has, not yet whether it is a date."""
    found = F.lit(None).cast("string")
    for name, (date, _) in reversed(SPELLINGS.items()):
        found = F.when(text.rlike(date + _TIME), F.lit(name)).otherwise(found)
    return found


def _ends(text: Column) -> tuple[Column, Column]:
    """The first two numbers of a date in numbers."""
    pattern = SPELLINGS["numbers"][0] + _TIME
    return _number(_part(text, pattern, 1)), _number(_part(text, pattern, 2))


def _month(name: Column) -> Column:
    """The number of a month by its first three letters; missing for another word."""
    short = F.lower(F.substring(name, 1, 3))
    whole = F.array(*[F.lit(month) for month in fixed.MONTHS])
    place = F.array_position(F.transform(whole, lambda month: F.substring(month, 1, 3)), short)
    return F.when((place > 0) & F.startswith(F.get(whole, (place - 1).cast("int")), F.lower(name)), place.cast("int"))


def _year(part: Column) -> Column:
    """Two digits are of the years 1969 to 2068."""
    number = _number(part)
    return F.when(F.length(part) > 2, number).when(number < 69, number + 2000).otherwise(number + 1900)


def _clock(text: Column, pattern: str) -> Column:
    """hh:mm:ss.f and offset behind a date; midnight without a time, missing for an hour that 12-hour clocks lack."""
    hour, half = _number(_part(text, pattern, 4)), F.upper(F.substring(_part(text, pattern, 8), 1, 1))
    full = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    seconds, fraction = _part(text, pattern, 6), _part(text, pattern, 7)
    spelled = F.concat(
        F.lpad(full.cast("string"), 2, "0"), F.lit(":"), _part(text, pattern, 5), F.lit(":"),
        F.when(seconds == "", "00").otherwise(seconds), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)))
    zone = _part(text, pattern, 9)
    offset = F.when(zone.rlike(r"\d{4}$"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, 4, 2))).otherwise(zone)
    return F.when(_part(text, pattern, 4) == "", F.lit("00:00:00")).otherwise(F.concat(spelled, offset))


def _read(text: Column, name: str, day_first: Column) -> Column:
    date, order = SPELLINGS[name]
    pattern = date + _TIME
    parts = {kind: _part(text, pattern, at) for at, kind in enumerate(order, 1)}
    year = _year(parts["y"])
    if order == "??y":
        one, two = _ends(text)
        # Where only one order gives a month it is that one; else the column's.
        swapped = F.when(one > 12, F.lit(True)).when(two > 12, F.lit(False)).otherwise(day_first)
        month, day = F.when(swapped, two).otherwise(one), F.when(swapped, one).otherwise(two)
    else:
        month = _month(parts["n"]) if "n" in parts else _number(parts["m"])
        day = _number(parts["d"])
    pieces = [F.lpad(year.cast("string"), 4, "0"), *[F.lpad(x.cast("string"), 2, "0") for x in (month, day)]]
    return F.concat(F.concat_ws("-", *pieces), F.lit(" "), _clock(text, pattern)).try_cast("timestamp")


def moment_or_missing(column: Column, day_first: Column | bool = False) -> Column:
    """The moment that a text spells; missing where no spelling reads it.

    Years in front, compact, numbers with the year last, month names; `-`, `/` or `.` between numbers; times with
    minutes, seconds or fractions, on a 12- or 24-hour clock, with an offset. 13/02/2024 can only be a day in front;
    where both orders are possible, `day_first` decides. Dates that are none, such as 31 April, are missing.
    """
    text = _text(column)
    day_first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    iso = F.when(text.rlike(r"^\d{4}-\d"), text.try_cast("timestamp"))
    read = F.lit(None).cast("timestamp")
    for name, (date, _) in reversed(SPELLINGS.items()):
        read = F.when(text.rlike(date + _TIME), _read(text, name, day_first)).otherwise(read)
    return F.coalesce(iso, read)


def day_comes_first(df: DataFrame, column: str) -> Column:
    """Whether more dates in numbers of a text column must have the day in front than the month; one pass, one number."""
    one, two = _ends(_text(F.col(f"`{column}`")))
    votes = F.count_if((one > 12) & (two <= 12)) - F.count_if((two > 12) & (one <= 12))
    return df.agg(votes > 0).scalar()


def inferred_moment(df: DataFrame, column: str) -> Column:
    """The moments of a column: as they are, or read from text in the order of day and month that its own values show."""
    if dict(df.dtypes)[column] != "string":
        return F.col(f"`{column}`").try_cast("timestamp")
    return moment_or_missing(F.col(f"`{column}`"), day_comes_first(df, column))


def spellings(df: DataFrame, column: str) -> DataFrame:
    """(spelling, rows) of a text column's present values; those that give no moment are `unread`."""
    text = _text(F.col(f"`{column}`"))
    name = F.when(inferred_moment(df, column).isNotNull(), F.coalesce(_spelled(text), F.lit("year first"))).otherwise(F.lit(UNREAD))
    return df.where(text.isNotNull() & (text != "")).groupBy(name.alias("spelling")).agg(F.count("*").alias("rows"))
