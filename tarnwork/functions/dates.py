"""Times: UTC forms, ISO weeks, recency, windows of the wall clock."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_of(instant: Column) -> Column:
    """Monday of an instant's UTC week."""
    return F.date_trunc("week", instant).cast("date")


def utc_text(instant: Column) -> Column:
    """ISO text in UTC, to the second."""
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_utc(text: Column) -> Column:
    """Instant of an ISO text: without zone it is UTC, a bare date is midnight; null when malformed."""
    return F.when(text.rlike(r"^\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:?\d\d)?)?$"), F.try_to_timestamp(text))


def recency(age_days: Column, half_life: float | Column) -> Column:
    """2 to the minus age over half-life; the future counts as now, an unknown age as never."""
    return F.when(age_days.isNull(), 0.0).otherwise(F.pow(F.lit(2.0), -F.greatest(age_days.cast("double"), F.lit(0.0)) / half_life))


def is_stale(at: Column, now: Column, hours: float) -> Column:
    """Whether `at` lies at least `hours` before `now`; an unknown time is stale."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(at) >= hours * 3600, F.lit(True))


def wall_clock(day: date, hour: int, minute: int, zone: str) -> datetime:
    """The UTC instant of a wall-clock time; one that a clock change skips is the same distance behind it."""
    local = datetime(day.year, day.month, day.day, hour, minute, tzinfo=ZoneInfo(zone))
    return local.astimezone(timezone.utc)


def latest_window(now: datetime, hour: int, minute: int, zone: str) -> datetime:
    """The last daily window at or before `now`."""
    day = now.astimezone(ZoneInfo(zone)).date()
    at = wall_clock(day, hour, minute, zone)
    return at if at <= now else wall_clock(day - timedelta(days=1), hour, minute, zone)


def due_jobs(last_runs: dict[str, datetime | None], windows: dict[str, tuple[int, int]], now: datetime, zone: str) -> list[str]:
    """Jobs whose latest window no run has reached yet; missed windows count once."""
    out = []
    for job, (hour, minute) in windows.items():
        window, last = latest_window(now, hour, minute, zone), last_runs.get(job)
        if last is None or last < window:
            out.append(job)
    return out
