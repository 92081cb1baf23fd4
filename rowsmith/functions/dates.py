"""Date and time functions (X3-X5). Timestamps are zone-less (TIMESTAMP_NTZ)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz_literal(value: dt.datetime | dt.date | str) -> Column:
    """A zone-less timestamp literal. Built from ISO text, so neither the
    session time zone nor the Python process's zone can shift it (a Python
    ``datetime`` passed to ``lit`` would become a zoned instant first)."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat() + " 00:00:00"
    return F.lit(value).cast("timestamp_ntz")


_MDY = r"^[0-9]{1,2}/[0-9]{1,2}/([0-9]{2}|[0-9]{4})$"


def parse_mdy(text: Column | str, pivot: int = 50) -> Column:
    """``MM/DD/YY`` text to a TIMESTAMP_NTZ at midnight.

    Two-digit years are read with a pivot: ``yy >= pivot`` is 19yy, else 20yy
    (Spark's own ``yy`` pattern would read 88 as 2088). Four-digit years pass
    through. Text that is not of that shape, or not a real date (02/30/99),
    gives NULL. No time zone is involved at any step.
    """
    t = _c(text)
    parts = F.split(t, "/")
    mm, dd, yy = (F.try_element_at(parts, F.lit(i)) for i in (1, 2, 3))
    y = yy.try_cast("int")
    year = F.when(F.length(yy) == 4, y).when(y >= pivot, y + 1900).otherwise(y + 2000)
    ts = F.try_make_timestamp_ntz(year, mm.try_cast("int"), dd.try_cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return F.when(t.rlike(_MDY), ts)


def format_mdy(ts: Column | str) -> Column:
    """Inverse of ``parse_mdy`` for years 1950-2049: ``MM/dd/yy`` text."""
    return F.date_format(_c(ts), "MM/dd/yy")


def days_between(start: Column | str, end: Column | str) -> Column:
    """``end - start`` as a (fractional) number of days, double.

    Zone-less timestamps are subtracted as wall-clock values (the interval
    ``end - start``, read as seconds to the microsecond). ``timestampdiff``
    is not used: on TIMESTAMP_NTZ it passes through the session time zone
    and is an hour off around a daylight-saving change."""
    secs = (_c(end) - _c(start)).cast("decimal(18,6)")
    return secs.cast("double") / F.lit(86400.0)


def minus_days(as_of: Column | dt.datetime | str, days: int) -> Column:
    """``as_of - days`` (a timestamp), with ``as_of`` a parameter."""
    base = as_of if isinstance(as_of, Column) else ntz_literal(as_of)
    return base - F.make_dt_interval(F.lit(days))
