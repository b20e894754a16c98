"""Calendar rules: briefing anchor, next session, cut-off days, ISO weeks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"
DESK_ZONE = "Asia/Taipei"


def moment(now: datetime) -> Column:
    """A naive UTC time as a literal that no session or machine zone can shift."""
    return F.to_timestamp_ntz(F.lit(now.strftime("%Y-%m-%d %H:%M:%S")))


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def back_to_weekday(day: Column) -> Column:
    """The day itself, or the Friday before a weekend day."""
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def forward_to_weekday(day: Column) -> Column:
    """The day itself, or the Monday after a weekend day."""
    return F.when(F.weekday(day) >= 5, F.date_add(day, 7 - F.weekday(day))).otherwise(day)


def session_date(now_utc: Column) -> Column:
    """Day of the last 17:15 market-zone anchor that is not after `now`, on a weekday."""
    local = F.from_utc_timestamp(now_utc, MARKET_ZONE)
    minute_of_day = F.hour(local) * 60 + F.minute(local)
    day = F.to_date(local)
    return back_to_weekday(F.when(minute_of_day >= 17 * 60 + 15, day).otherwise(F.date_sub(day, 1)))


def anchor_local(now_utc: Column) -> Column:
    """The anchor as market-zone wall-clock time."""
    return F.timestamp_seconds(F.unix_date(session_date(now_utc)).cast("long") * 86400 + (17 * 60 + 15) * 60)


def next_session(now_utc: Column) -> Column:
    return forward_to_weekday(F.date_add(session_date(now_utc), 1))


def news_cutoff(today: Column) -> Column:
    """Two days back; three on Mondays."""
    return F.date_sub(today, F.when(F.weekday(today) == 0, 3).otherwise(2))


def iso_week_key(day: Column, calendar_year: bool = False) -> Column:
    """Sort key of a week. `calendar_year` keeps the (year, ISO week) pair of the original rule."""
    if calendar_year:
        return F.year(day) * 100 + F.weekofyear(day)
    return F.unix_date(F.trunc(day, "week"))


def week_label(day: Column) -> Column:
    return F.concat(F.lit("W"), F.weekofyear(day))


def report_timing(hour: Column) -> Column:
    return F.when(hour < 12, "before-open").otherwise("after-close")
