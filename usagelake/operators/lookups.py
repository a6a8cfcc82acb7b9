"""Point lookups: one prompt, one session, whether an event is there, and what is newest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.contract import Tables
from usagelake.operators import prompts as pr


def _on(events: DataFrame, day: dt.date | None) -> DataFrame:
    """The day's partitions only, where the caller knows the day."""
    return events if day is None else events.where(F.col("local_date") == F.lit(day))


def prompt(tables: Tables, event_id: str, day: dt.date | None = None) -> DataFrame:
    """One prompt with its text, its next response and everything known about it."""
    return pr.details(tables, _on(tables.events, day).where(F.col("event_id") == event_id))


def session_of(tables: Tables, provider_id: str, external_id: str) -> DataFrame:
    """The session a provider knows under its own id, as (session_id, provider_id, events)."""
    return (
        tables.events
        .where((F.col("provider_id") == provider_id) & (F.col("external_session_id") == external_id))
        .groupBy("session_id", "provider_id").agg(F.count(F.lit(1)).alias("events"))
    )


def present(events: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys(event_id)`` with whether each is stored."""
    there = events.select("event_id").join(keys, "event_id", "left_semi").distinct()
    return keys.distinct().join(there.withColumn("present", F.lit(True)), "event_id", "left").select(
        "event_id", F.coalesce("present", F.lit(False)).alias("present"))


def newest(events: DataFrame) -> DataFrame:
    """The newest event of every provider; equal instants go to the larger id."""
    last = F.max(F.struct("ts_ms", "event_id"))
    return events.groupBy("provider_id").agg(last.alias("last")).select(
        "provider_id", "last.event_id", "last.ts_ms")


def sessions_without_start(events: DataFrame) -> DataFrame:
    """Sessions whose start was never reported as an event of its own."""
    started = F.max((F.col("event_type") == "session_start").cast("int"))
    return (
        events.where(F.col("session_id").isNotNull()).groupBy("session_id")
        .agg(started.alias("started")).where("started = 0").select("session_id")
    )
