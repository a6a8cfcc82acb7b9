"""Turning an ``EventFilters`` into DataFrame predicates and semi/anti joins."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.contract import EventFilters, Tables
from usagelake.rules.words import MACHINE_PREFIXES


def _epoch_ms(value: dt.datetime) -> int:
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    delta = value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return delta // dt.timedelta(milliseconds=1)


def event_predicate(f: EventFilters) -> Column:
    """Conjunction over the event's own columns; partition columns prune, the rest push down."""
    clauses: list[Column] = []
    if f.from_day or f.to_day:
        if f.from_day:
            clauses.append(F.col("local_date") >= F.lit(f.from_day).cast("date"))
        if f.to_day:
            clauses.append(F.col("local_date") <= F.lit(f.to_day).cast("date"))
    else:
        if f.from_ts:
            clauses.append(F.col("ts_ms") >= _epoch_ms(f.from_ts))
        if f.to_ts:
            clauses.append(F.col("ts_ms") <= _epoch_ms(f.to_ts))
    for column in ("provider_id", "project_id", "model", "session_id", "event_type"):
        value = getattr(f, column)
        if value:
            clauses.append(F.col(column) == value)
    if f.include_subagents is False:
        clauses.append(~F.col("is_subagent"))
    return reduce(lambda a, b: a & b, clauses) if clauses else F.lit(True)


def prune(tables: Tables, f: EventFilters | None) -> Tables:
    """Side tables limited to the days of the slice, so that their partitions prune as well."""
    if f is None or not (f.from_day or f.to_day):
        return tables
    days = event_predicate(EventFilters(from_day=f.from_day, to_day=f.to_day))
    sides = {}
    for name in ("prompts", "responses", "tool_calls", "classifications", "technologies",
                 "contexts"):
        df = getattr(tables, name)
        if df is not None and "local_date" in df.columns:
            sides[name] = df.where(days)
    return tables.but(**sides)


def machine_text(preview: Column) -> Column:
    """Text written into the prompt channel by tooling rather than by the person."""
    options = "|".join(re.escape(p).replace("_", ".") for p in MACHINE_PREFIXES)
    return preview.rlike(f"(?is)^(?:{options})")


def apply_filters(tables: Tables, f: EventFilters | None = None, **changes) -> DataFrame:
    """Events of the slice. Side-table conditions become semi and anti joins on ``event_id``."""
    f = (f or EventFilters()).but(**changes) if changes else (f or EventFilters())
    tables = prune(tables, f)
    events = tables.events.where(event_predicate(f))
    if f.include_subagents is False and tables.prompts is not None:
        machine = tables.prompts.where(machine_text(F.col("preview"))).select("event_id")
        events = events.join(machine, "event_id", "left_anti")
    if f.category:
        wanted = tables.classifications.where(F.col("category") == f.category)
        events = events.join(wanted.select("event_id"), "event_id", "left_semi")
    if f.technology:
        wanted = tables.technologies.where(F.col("technology") == f.technology)
        events = events.join(wanted.select("event_id"), "event_id", "left_semi")
    return events


def after_cursor(ts_ms: int, event_id: str) -> Column:
    """Rows strictly older than the cursor in (time, id) order."""
    return (F.col("ts_ms") < ts_ms) | ((F.col("ts_ms") == ts_ms) & (F.col("event_id") < event_id))
