"""Dates and times. Operators never read the clock: they take ``as_of``."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = datetime | str


def as_datetime(as_of: AsOf) -> datetime:
    return as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)


def moment_before(as_of: AsOf, **minus: float) -> datetime:
    return as_datetime(as_of) - timedelta(**minus)


def ts_lit(as_of: AsOf, **minus: float) -> Column:
    """A UTC timestamp literal, ``minus`` a timedelta; independent of the driver's time zone."""
    moment = moment_before(as_of, **minus)
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def day_before(as_of: AsOf, days: int = 0) -> date:
    return as_datetime(as_of).date() - timedelta(days=days)


def week_start(day: Column) -> Column:
    """First day of a Sunday-started week."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def week_start_of(day: date) -> date:
    return day - timedelta(days=(day.weekday() + 1) % 7)


def event_day(df: DataFrame) -> Column:
    """The partition column where there is one, so that day filters prune partitions."""
    return F.col("day") if "day" in df.columns else F.to_date("timestamp")


def time_range(df: DataFrame, since: AsOf | None = None, until: AsOf | None = None) -> DataFrame:
    """Rows with ``since <= timestamp <= until``, with the matching day filter added.

    A filter on ``timestamp`` alone does not prune day partitions.
    """
    if since is not None:
        df = df.filter((event_day(df) >= F.lit(as_datetime(since).date())) & (F.col("timestamp") >= ts_lit(since)))
    if until is not None:
        df = df.filter((event_day(df) <= F.lit(as_datetime(until).date())) & (F.col("timestamp") <= ts_lit(until)))
    return df
