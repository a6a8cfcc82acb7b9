"""Local-day arithmetic. Everything works on epoch milliseconds, so no session zone matters."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def _day_number(ms: Column) -> Column:
    return F.floor(ms / F.lit(DAY_MS)).cast("int")


def local_ms(ms: Column, offset_minutes: Column) -> Column:
    return F.coalesce(ms, F.lit(0)) + offset_minutes.cast("bigint") * F.lit(60_000)


def local_date(ms: Column, offset_minutes: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _day_number(local_ms(ms, offset_minutes)))


def local_hour(ms: Column, offset_minutes: Column) -> Column:
    within = F.pmod(local_ms(ms, offset_minutes), F.lit(DAY_MS))
    return F.floor(within / F.lit(HOUR_MS)).cast("int")


def local_weekday(ms: Column, offset_minutes: Column) -> Column:
    """0 = Sunday; 1970-01-01 was a Thursday."""
    return F.pmod(_day_number(local_ms(ms, offset_minutes)) + 4, F.lit(7)).cast("int")


def iso_utc(ms: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` without going through the session zone."""
    zero = F.lit(0)
    day = local_date(ms, zero).cast("string")
    within = F.pmod(ms, F.lit(DAY_MS)).cast("bigint")

    def part(divisor: int, modulus: int, width: int) -> Column:
        value = F.pmod(F.floor(within / F.lit(divisor)), F.lit(modulus)).cast("string")
        return F.lpad(value, width, "0")

    return F.concat(
        day, F.lit("T"), part(HOUR_MS, 24, 2), F.lit(":"), part(60_000, 60, 2),
        F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"),
    )


def known_zone(zone: str) -> bool:
    try:
        zoneinfo.ZoneInfo(zone)
        return bool(zone)
    except Exception:
        return False


def zone_offset_minutes(ts: Column, zone: str) -> Column:
    """Offset in force in ``zone`` at the instant itself; an unknown zone counts as UTC."""
    if not known_zone(zone):
        return F.lit(0)
    shift = F.unix_millis(F.from_utc_timestamp(ts, zone)) - F.unix_millis(ts)
    return F.floor(shift / F.lit(60_000) + F.lit(0.5)).cast("int")


def local_date_in(ts: Column, zone: str) -> Column:
    return local_date(epoch_ms(ts), zone_offset_minutes(ts, zone))


def local_day_start_ms(day: Column, zone: str) -> Column:
    """UTC instant at which the local day begins."""
    midnight = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(DAY_MS)
    return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(midnight), zone))


def local_day_end_ms(day: Column, zone: str) -> Column:
    """Last millisecond of the local day as a UTC instant."""
    last = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * F.lit(DAY_MS)
    return F.unix_millis(
        F.to_utc_timestamp(F.timestamp_millis(last + F.lit(DAY_MS - 1)), zone)
    )


def add_local_days(day: Column, days: int | Column) -> Column:
    return F.date_add(day, days)


def diff_local_days(from_day: Column, to_day: Column) -> Column:
    return F.datediff(to_day, from_day)


def week_bucket(day: Column) -> Column:
    """Year and week of year with Monday-started weeks, days before the first Monday in W00."""
    monday_based = F.pmod(F.dayofweek(day) + 5, F.lit(7))
    week = F.floor((F.dayofyear(day) + F.lit(6) - monday_based) / F.lit(7)).cast("int")
    return F.format_string("%04d-W%02d", F.year(day), week)


def bucket(granularity: str, day: Column, hour: Column) -> Column:
    if granularity == "hour":
        return F.format_string("%sT%02d", day.cast("string"), hour)
    if granularity == "week":
        return week_bucket(day)
    if granularity == "day":
        return day.cast("string")
    raise ValueError(f"unknown granularity {granularity!r}")
