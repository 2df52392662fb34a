"""Local-day windows, periods and their labels; the time zone is a parameter everywhere."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Edmonton"
ISO = "yyyy-MM-dd'T'HH:mm:ssxxx"


def to_iso(instant: datetime) -> str:
    return instant.astimezone(UTC).isoformat(timespec="seconds")


def from_iso(text: str) -> datetime:
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if found.tzinfo is None:
        raise ValueError(f"no offset in {text!r}")
    return found.astimezone(UTC)


@dataclass(frozen=True)
class Span:
    """A half-open stretch of time made of whole local days."""

    start: datetime
    end: datetime
    days: int
    key: str = ""

    def contains(self, at: Column) -> Column:
        """Both bounds are literals, so they reach the scan and prune partitions."""
        return (at >= F.lit(self.start)) & (at < F.lit(self.end))


def _midnight(day: date, zone: str) -> datetime:
    return datetime.combine(day, time(), ZoneInfo(zone)).astimezone(UTC)


def local_date(instant: datetime, zone: str = ZONE) -> date:
    return instant.astimezone(ZoneInfo(zone)).date()


def trailing(instant: datetime, days: int, zone: str = ZONE) -> Span:
    """The ``days`` local days that end at the last local midnight."""
    if days <= 0:
        raise ValueError("days must be positive")
    end = local_date(instant, zone)
    return Span(_midnight(end - timedelta(days=days), zone), _midnight(end, zone), days)


def preceding(span: Span, zone: str = ZONE) -> Span:
    """As many local days right before."""
    first = local_date(span.start, zone)
    return Span(_midnight(first - timedelta(days=span.days), zone), span.start, span.days)


def day(of: date, zone: str = ZONE) -> Span:
    return Span(_midnight(of, zone), _midnight(of + timedelta(days=1), zone), 1, of.isoformat())


def recent_days(instant: datetime, count: int, zone: str = ZONE) -> list[Span]:
    """Completed local days, newest first."""
    today = local_date(instant, zone)
    return [day(today - timedelta(days=k), zone) for k in range(1, count + 1)]


def previous_day(instant: datetime, zone: str = ZONE) -> Span:
    return recent_days(instant, 1, zone)[0]


def previous_iso_week(instant: datetime, zone: str = ZONE) -> Span:
    today = local_date(instant, zone)
    monday = today - timedelta(days=today.weekday() + 7)
    year, week, _ = monday.isocalendar()
    return Span(_midnight(monday, zone), _midnight(monday + timedelta(days=7), zone), 7, f"{year}-W{week:02d}")


def digest_gate(instant: datetime, daily_exists: bool, weekly_exists: bool, hour: int = 5, zone: str = ZONE) -> tuple[bool, bool]:
    """(make the daily digest now, make the weekly one now)."""
    local = instant.astimezone(ZoneInfo(zone))
    open_ = local.hour >= hour
    return open_ and not daily_exists, open_ and local.weekday() == 0 and not weekly_exists


def next_run(instant: datetime, daily_exists: bool, hour: int = 5, zone: str = ZONE) -> datetime:
    """The next local ``hour``; today's counts while it has no digest yet and lies ahead, or is still owed."""
    local = instant.astimezone(ZoneInfo(zone))
    today = datetime.combine(local.date(), time(hour), ZoneInfo(zone))
    if local < today or not daily_exists:
        return today.astimezone(UTC)
    return datetime.combine(local.date() + timedelta(days=1), time(hour), ZoneInfo(zone)).astimezone(UTC)


# columns
def iso_column(at: Column) -> Column:
    return F.date_format(at, ISO)


def local_date_column(at: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))


def iso_week_key(day_: Column) -> Column:
    return F.concat(F.extract(F.lit("yearofweek"), day_).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day_).cast("string"), 2, "0"))


def leading_date(iso: Column) -> Column:
    """The date that a timestamp text starts with; anything else raises."""
    text = F.substring(iso, 1, 10)
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.to_date(text)).otherwise(F.raise_error(F.concat(F.lit("no leading date: "), iso)).cast("date"))


def epoch_iso(seconds: Column) -> Column:
    return iso_column(F.timestamp_seconds(seconds))


def recency_days(last: Column, now: Column) -> Column:
    """Whole UTC days since ``last``, 0 at least; null where there is none."""
    return F.when(last.isNotNull(), F.greatest(F.datediff(F.to_date(now), F.to_date(last)), F.lit(0)))


def recency_label(days: Column) -> Column:
    return (
        F.when(days.isNull(), F.lit("never")).when(days == 0, F.lit("today")).when(days == 1, F.lit("1 day ago"))
        .otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    )
