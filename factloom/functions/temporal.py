"""Time text to instants, and the half-open interval predicates.

All arithmetic is on seconds since 1970 in UTC (BIGINT), so neither the
session time zone nor the range of nanosecond timestamps matters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The written forms of a time.
YEAR = "^[0-9]{4}$"
MONTH = "^[0-9]{4}-[0-9]{2}$"
DAY = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
INSTANT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$"
LOCAL = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?$"

#: Bounds that no written time reaches: a day before year 1 and after year 9999, for zones shift by hours.
BEFORE_ALL, AFTER_ALL = -62135596800 - 86400, 253402300799 + 86400


def stripped(text: Column) -> Column:
    """Text without surrounding blanks, tabs and line ends."""
    return F.btrim(text, F.lit(" \t\n\r"))


def precision(text: Column) -> Column:
    """year, month, day or instant by the written form, else null."""
    t = stripped(text)
    return (
        F.when(t.rlike(YEAR), "year")
        .when(t.rlike(MONTH), "month")
        .when(t.rlike(DAY), "day")
        .when(t.rlike(INSTANT) | t.rlike(LOCAL), "instant")
    )


def is_naive(text: Column) -> Column:
    """True for an instant written without a zone; such a time has no place on the time line."""
    return stripped(text).rlike(LOCAL)


def earliest_second(text: Column) -> Column:
    """First second (UTC, since 1970) of the year, month, day or instant written.

    Null for null, for any other form, for impossible dates and clock times and
    for naive instants.  Years are 1 to 9999.
    """
    t = stripped(text)
    whole = (
        F.when(t < "0001", F.lit(None))
        .when(t.rlike(INSTANT), t)
        .when(t.rlike(DAY), F.concat(t, F.lit("T00:00:00Z")))
        .when(t.rlike(MONTH), F.concat(t, F.lit("-01T00:00:00Z")))
        .when(t.rlike(YEAR), F.concat(t, F.lit("-01-01T00:00:00Z")))
    )
    return F.unix_seconds(whole.try_cast("timestamp"))


def written(seconds: Column) -> Column:
    """YYYY-MM-DDThh:mm:ssZ of seconds since 1970; null stays null."""
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(
        day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest % 3600 / 60)), F.lit(":"), two(rest % 60), F.lit("Z")
    )


def contains(start: Column, end: Column, at: Column) -> Column:
    """Whether [start, end) holds ``at``; a null bound is open."""
    return (start.isNull() | (at >= start)) & (end.isNull() | (at < end))


def overlaps(a_from: Column, a_to: Column, b_from: Column, b_to: Column) -> Column:
    """Whether two half-open intervals share an instant; null bounds are open."""
    return (a_to.isNull() | b_from.isNull() | (a_to > b_from)) & (b_to.isNull() | a_from.isNull() | (b_to > a_from))
