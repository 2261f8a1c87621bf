"""Calendar features and the trading calendar.

The calendar is a dimension table ``sessions(trade_date DATE)``. It has at
most one row per day of the covered range (a few thousand rows per decade),
so joins against it broadcast it: the size bound is the date range, not the
data volume.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exchange closures on fixed calendar dates (month, day):
# New Year's Day, Labour Day, Christmas Eve, Christmas Day, Boxing Day, New Year's Eve.
FIXED_CLOSURES = [(1, 1), (5, 1), (12, 24), (12, 25), (12, 26), (12, 31)]


def as_utc(col: str = "ts", source_tz: str | None = None) -> Column:
    """Naive time → UTC instant; with ``source_tz`` the naive value is
    read as wall time of that zone. Aware values are already instants."""
    c = F.col(col)
    if source_tz:
        return F.to_utc_timestamp(c.cast("timestamp_ntz").cast("timestamp"), source_tz)
    return c.cast("timestamp")


def trade_date(col: str = "ts") -> Column:
    """date of the bar in UTC (session time zone is UTC)."""
    return F.to_date(col)


def weekday(col: str = "ts") -> Column:
    """Monday = 0."""
    return F.weekday(col)


def month_end(col: str = "ts") -> Column:
    """1 on the last calendar day of the month."""
    return (F.to_date(col) == F.last_day(col)).cast("int")


def index_bounds(bars: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """First and last date (per key, or overall)."""
    d = trade_date()
    return bars.groupBy(*keys).agg(F.min(d).alias("first_date"), F.max(d).alias("last_date"))


def distinct_sessions(bars: DataFrame) -> DataFrame:
    """The set of dates that have bars."""
    return bars.select(trade_date().alias("trade_date")).distinct()


def rule_calendar(bars: DataFrame, closures: list[tuple[int, int]] | None = None) -> DataFrame:
    """Sessions = weekdays between the bars' first and last date, minus fixed
    closures. One row per day of the range: bounded by the range."""
    closures = FIXED_CLOSURES if closures is None else closures
    b = index_bounds(bars)
    days = b.select(F.explode(F.sequence("first_date", "last_date")).alias("trade_date"))
    closed = F.lit(False)
    for m, d in closures:
        closed = closed | ((F.month("trade_date") == m) & (F.dayofmonth("trade_date") == d))
    return days.where((F.weekday("trade_date") < 5) & ~closed)


def holiday_flag(bars: DataFrame, sessions: DataFrame | None) -> DataFrame:
    """holiday_flag = 1 when the bar's date is not a session; 0 for all
    rows without a calendar."""
    if sessions is None:
        return bars.withColumn("holiday_flag", F.lit(0))
    s = F.broadcast(sessions.select("trade_date").distinct().withColumn("_open", F.lit(1)))
    j = bars.join(s, trade_date() == s["trade_date"], "left")
    return j.withColumn("holiday_flag", F.when(F.col("_open").isNull(), 1).otherwise(0)).drop("_open", "trade_date")


def session_filter(bars: DataFrame, sessions: DataFrame, keep_sessions: bool = True) -> DataFrame:
    """Bars on sessions (semi join) or off sessions (anti join)."""
    s = F.broadcast(sessions.select("trade_date").distinct())
    how = "left_semi" if keep_sessions else "left_anti"
    return bars.join(s, trade_date() == s["trade_date"], how)


def calendar_columns() -> dict[str, Column]:
    return {"weekday": weekday(), "month_end": month_end()}
