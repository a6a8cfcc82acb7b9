"""Builders of small hand-checkable logs."""

from __future__ import annotations

import datetime as dt

from usagelake.contract import EVENT_INPUT, Settings
from usagelake.operators import normalize as nz

BASE = dt.datetime(2026, 6, 1, 9, 0, tzinfo=dt.timezone.utc)


def at(minutes: float = 0, base: dt.datetime = BASE) -> str:
    moment = base + dt.timedelta(minutes=minutes)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.") + f"{moment.microsecond // 1000:03d}Z"


def event(n: int | str | None, kind: str = "prompt", minutes: float = 0, **fields) -> dict:
    row = {
        "external_id": None if n is None else str(n), "provider_id": "tool-a",
        "timestamp": at(minutes), "tz_offset_minutes": 0, "session_id": "s1",
        "event_type": kind,
    }
    row.update(fields)
    return row


def source(spark, rows):
    names = EVENT_INPUT.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], EVENT_INPUT)


def log(spark, rows, settings: Settings | None = None):
    return nz.normalize(source(spark, rows), settings or Settings())


def tables(spark, rows, settings: Settings | None = None):
    return nz.split_tables(log(spark, rows, settings))
