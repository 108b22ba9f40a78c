"""Calendar column expressions.

Publication times are wall-clock times without a zone.  They are kept as
``TIMESTAMP_NTZ`` so that day, hour and weekday never depend on the session
time zone.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsfeat.functions.fixed import BEFORE_HOLIDAY_FROM_HOUR, HOLIDAYS

PUBDATE_FORMAT = "yyyy-MM-dd HH:mm:ss"


def parse_pubdate(c) -> Column:
    """String ``yyyy-MM-dd HH:mm:ss`` -> ``TIMESTAMP_NTZ``; unparsable -> null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.try_to_timestamp(col, F.lit(PUBDATE_FORMAT)).cast("timestamp_ntz")


def pub_day(ts) -> Column:
    return F.to_date(ts)


def weekday_sun0(ts) -> Column:
    """0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(ts) - 1).cast("int")


def hour_of(ts) -> Column:
    return F.hour(ts).cast("int")


def weekday_name(ts) -> Column:
    return F.date_format(ts, "EEEE")


def weekday_mon0(ts) -> Column:
    """Factor order of the weekday names: 0 = Monday ... 6 = Sunday."""
    return F.weekday(ts).cast("int")


def year_day0(ts) -> Column:
    """0-based day of the year."""
    return (F.dayofyear(ts) - 1).cast("int")


def holiday_year_days(dates: list[str] = HOLIDAYS) -> list[int]:
    """0-based day-of-year of each holiday (compared year-agnostically)."""
    return sorted({_dt.date.fromisoformat(d).timetuple().tm_yday - 1 for d in dates})


def holiday_flag(ts, dates: list[str] = HOLIDAYS) -> Column:
    return F.coalesce(year_day0(ts).isin(holiday_year_days(dates)), F.lit(False)).cast("int")


def before_holiday_flag(ts, dates: list[str] = HOLIDAYS,
                        from_hour: int = BEFORE_HOLIDAY_FROM_HOUR) -> Column:
    eve = [d - 1 for d in holiday_year_days(dates)]
    cond = year_day0(ts).isin(eve) & (F.hour(ts) >= from_hour)
    return F.coalesce(cond, F.lit(False)).cast("int")
