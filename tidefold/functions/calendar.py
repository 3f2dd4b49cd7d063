"""Japan-time calendar: a fixed offset of nine hours, the same on zoned and zoneless timestamps."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH = re.compile(r"[0-9]{4}-(0[1-9]|1[0-2])", re.A)
OFFSET = timedelta(hours=9)


def japan(ts: Column) -> Column:
    return ts + F.expr("INTERVAL 9 HOURS")


def jst_month(ts: Column) -> Column:
    """YYYY-MM of an instant."""
    return F.date_format(japan(ts), "yyyy-MM")


def jst_weekday(ms: Column) -> Column:
    """0 (Sunday) to 6 of epoch milliseconds."""
    days = F.floor((ms + 9 * 3_600_000) / 86_400_000)
    return F.pmod(days + 4, F.lit(7)).cast("int")  # day 0 was a Thursday


def near_jst_midnight(ms: Column, minutes: int = 15) -> Column:
    at = F.pmod(ms + 9 * 3_600_000, F.lit(86_400_000))
    return (at <= minutes * 60_000) | (at >= 86_400_000 - minutes * 60_000)


def iso_millis(ts: Column) -> Column:
    """UTC text with milliseconds, cut off, not rounded."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_month(month: Column) -> Column:
    return month.rlike(r"\A[0-9]{4}-(0[1-9]|1[0-2])\z")


def month_bounds_columns(month: Column) -> tuple[Column, Column]:
    """K13 on columns: first instant of the month and of the next one, in UTC; null if it is no month."""
    first = F.when(is_month(month), F.to_timestamp(F.concat(month, F.lit("-01")), "yyyy-MM-dd"))
    after = F.add_months(first.cast("date"), 1).cast("timestamp")
    return first - F.expr("INTERVAL 9 HOURS"), after - F.expr("INTERVAL 9 HOURS")


def month_bounds(month: str) -> tuple[datetime, datetime]:
    """[first instant, first instant after) in UTC, without zone."""
    if not isinstance(month, str) or not MONTH.fullmatch(month):
        raise ValueError(f"not a month: {month!r}")
    year, number = int(month[:4]), int(month[5:])
    after = datetime(year + number // 12, number % 12 + 1, 1)
    return datetime(year, number, 1) - OFFSET, after - OFFSET


def adjacent_months(now: datetime) -> tuple[str, str]:
    """The month before the one in which now (UTC) lies in Japan, and the month after it."""
    here = (now + OFFSET).replace(day=1)
    before, after = here - timedelta(days=1), here + timedelta(days=31)
    return f"{before:%Y-%m}", f"{after:%Y-%m}"


def adjacent_month_columns(ts: Column) -> tuple[Column, Column]:
    """K14 on columns: the month before the one in which an instant (UTC) lies in Japan, and the month after it."""
    here = F.trunc(japan(ts).cast("date"), "month")
    return tuple(F.date_format(F.add_months(here, n), "yyyy-MM") for n in (-1, 1))
