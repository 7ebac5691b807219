"""Calendar helpers: period labels, ISO weeks, weekdays, invoice datetime parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def yyyy_mm_label(col: Column | str) -> Column:
    """'YYYY_MM' with a zero-padded month (e.g. 2018_05)."""
    return F.date_format(_c(col).cast("date"), "yyyy_MM")


def iso_week(col: Column | str) -> Column:
    """ISO-8601 week number (1-53)."""
    return F.weekofyear(_c(col).cast("date"))


def iso_year(col: Column | str) -> Column:
    """ISO-8601 week-numbering year (the year that owns the ISO week)."""
    d = _c(col).cast("date")
    # The Thursday of the date's ISO week decides the ISO year.
    thursday = F.date_add(d, 4 - ((F.dayofweek(d) + 5) % 7 + 1))
    return F.year(thursday)


def weekday_sun1(col: Column | str) -> Column:
    """Day of week with Sunday = 1 ... Saturday = 7."""
    return F.dayofweek(_c(col).cast("date"))


def last_week_end(col: Column | str, offset: int = 0) -> Column:
    """``d - DAY_OF_WEEK(d) + offset``: offset 0 gives the previous Saturday, 1 the Sunday."""
    d = _c(col).cast("date")
    return F.date_add(F.date_sub(d, F.dayofweek(d)), offset)


def month_back(col: Column | str, months: int = 1) -> Column:
    """The date ``months`` calendar months earlier (end-of-month clamped)."""
    return F.add_months(_c(col).cast("date"), -months)


# Invoice datetime text: month/day/year hour:minute with 1-2 digit fields and a
# 2- or 4-digit year.
_DT_RE = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4}) (\d{1,2}):(\d{2})$"


def parse_invoice_datetime(col: Column | str, two_digit_pivot: int = 50, strict_lengths: bool = False) -> Column:
    """Parse 'M/D/YYYY H:MM' and 'M/D/YY H:MM' text into a timestamp.

    The pattern is chosen by the year's digit count.  Two-digit years below
    ``two_digit_pivot`` map to 20YY, the rest to 19YY.  With ``strict_lengths``
    the original length rule applies: 16 characters use the 4-digit-year
    pattern, 14 or fewer the 2-digit-year one, anything else is NULL.
    """
    s = _c(col)
    parts = [F.regexp_extract(s, _DT_RE, i) for i in range(1, 6)]
    month, day, year_txt, hour, minute = parts
    yy = year_txt.cast("int")
    year = F.when(F.length(year_txt) == 4, yy).when(
        F.length(year_txt) == 2, F.when(yy < two_digit_pivot, yy + 2000).otherwise(yy + 1900)
    )
    ts = F.try_make_timestamp_ntz(
        years=year, months=month.cast("int"), days=day.cast("int"),
        hours=hour.cast("int"), mins=minute.cast("int"), secs=F.lit(0).cast("decimal(16,6)"),
    )
    ok = s.rlike(_DT_RE)
    if strict_lengths:
        n = F.length(s)
        ok = ok & (((n == 16) & (F.length(year_txt) == 4)) | ((n <= 14) & (F.length(year_txt) == 2)))
    return F.when(ok, ts)
