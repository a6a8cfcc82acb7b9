"""Question ranges: presets to local-day spans, the span before, and the bucket size."""

from __future__ import annotations

import datetime as dt
import zoneinfo
from dataclasses import dataclass

# Days covered by each preset, and the spans at which buckets widen.
PRESET_DAYS = {"today": 1, "7d": 7, "30d": 30, "3m": 90}
HOURLY_UP_TO_DAYS = 2
DAILY_UP_TO_DAYS = 120
DEFAULT_HISTORY_DAYS = 365


@dataclass(frozen=True)
class DaySpan:
    """Inclusive span of local days."""

    first: dt.date
    last: dt.date

    @property
    def days(self) -> int:
        return max(1, (self.last - self.first).days + 1)

    def previous(self) -> "DaySpan":
        """Span of the same length that ends the day before this one begins."""
        last = self.first - dt.timedelta(days=1)
        return DaySpan(last - dt.timedelta(days=self.days - 1), last)


@dataclass(frozen=True)
class ResolvedRange:
    preset: str
    timezone: str
    current: DaySpan
    previous: DaySpan

    def bounds(self, span: DaySpan) -> tuple[dt.datetime, dt.datetime]:
        """UTC instants of the first and last millisecond of a span, daylight saving included."""
        zone = zoneinfo.ZoneInfo(self.timezone)
        start = dt.datetime.combine(span.first, dt.time.min, zone)
        end = dt.datetime.combine(span.last, dt.time(23, 59, 59, 999000), zone)
        return start.astimezone(dt.timezone.utc), end.astimezone(dt.timezone.utc)

    @property
    def span_days(self) -> float:
        start, end = self.bounds(self.current)
        return (end - start) / dt.timedelta(days=1)


def _local_day(instant: dt.datetime, timezone: str) -> dt.date:
    if instant.tzinfo is None:
        instant = instant.replace(tzinfo=dt.timezone.utc)
    return instant.astimezone(zoneinfo.ZoneInfo(timezone)).date()


def resolve_range(
    preset: str, as_of: dt.datetime, timezone: str = "UTC",
    start: dt.datetime | None = None, end: dt.datetime | None = None,
    earliest: dt.datetime | None = None,
) -> ResolvedRange:
    """Local-day span of a preset as seen at ``as_of`` in the person's zone."""
    today = _local_day(as_of, timezone)
    if preset == "custom" and start and end:
        span = DaySpan(_local_day(start, timezone), _local_day(end, timezone))
    elif preset == "all":
        first = (
            _local_day(earliest, timezone) if earliest
            else today - dt.timedelta(days=DEFAULT_HISTORY_DAYS)
        )
        span = DaySpan(first, today)
    else:
        days = PRESET_DAYS.get(preset, 30)
        span = DaySpan(today - dt.timedelta(days=days - 1), today)
    return ResolvedRange(preset, timezone, span, span.previous())


def granularity_for(resolved: ResolvedRange) -> str:
    if resolved.span_days <= HOURLY_UP_TO_DAYS:
        return "hour"
    return "day" if resolved.span_days <= DAILY_UP_TO_DAYS else "week"
