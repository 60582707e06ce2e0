"""Calendar helpers as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month number -> three-letter label used in calendar feature names
MONTH_ABBR = {
    1: "jan", 2: "feb", 3: "mar", 4: "apr", 5: "may", 6: "jun",
    7: "jul", 8: "aug", 9: "sep", 10: "oct", 11: "nov", 12: "dec",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    """First day of the month as DATE (pandas ``to_period('M')`` equivalent)."""
    return F.trunc(F.to_date(_c(c)), "month")


def month_index(c) -> Column:
    """year*12 + month-1, an integer month counter for period arithmetic."""
    c = _c(c)
    return F.year(c) * 12 + F.month(c) - 1


def months_between_periods(later, earlier) -> Column:
    """Difference in calendar months (pandas Period difference ``.n``)."""
    return month_index(later) - month_index(earlier)


def month_label(c) -> Column:
    """'YYYY-MM' string of a date/timestamp (pandas ``str(Period('M'))``)."""
    return F.date_format(_c(c), "yyyy-MM")


def month_abbr(month_num) -> Column:
    m = F.create_map(*[x for k, v in MONTH_ABBR.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(month_num)]


def to_ntz(c, dtype) -> Column:
    """Normalise a string/date/timestamp column to TIMESTAMP_NTZ (wall clock).

    Meter readings are wall-clock local time; keeping them zone-free makes
    hour / weekday / price-period logic independent of the session time zone.
    """
    from pyspark.sql import types as T

    c = _c(c)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    return c.cast("timestamp_ntz")
