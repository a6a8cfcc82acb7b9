"""Deleting, erasing and expiring recorded data."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.contract import Tables
from usagelake.operators.filters import _epoch_ms

SCOPES = ("all", "prompts", "provider", "project", "range")


@dataclass(frozen=True)
class DeleteScope:
    scope: str
    provider_id: str | None = None
    project_id: str | None = None
    from_ts: dt.datetime | None = None
    to_ts: dt.datetime | None = None

    def __post_init__(self):
        if self.scope not in SCOPES:
            raise ValueError(f"unknown scope {self.scope!r}")
        missing = (
            (self.scope == "provider" and not self.provider_id)
            or (self.scope == "project" and not self.project_id)
            or (self.scope == "range" and not (self.from_ts and self.to_ts))
        )
        if missing:
            raise ValueError(f"scope {self.scope!r} is incomplete")

    def covers(self) -> Column:
        """Events the scope takes; null keys are not covered."""
        if self.scope == "provider":
            return F.coalesce(F.col("provider_id") == self.provider_id, F.lit(False))
        if self.scope == "project":
            return F.coalesce(F.col("project_id") == self.project_id, F.lit(False))
        if self.scope == "range":
            return F.col("ts_ms").between(_epoch_ms(self.from_ts), _epoch_ms(self.to_ts))
        return F.lit(True)


def delete_preview(tables: Tables, scope: DeleteScope) -> DataFrame:
    """Counts of what a deletion would remove, as one row."""
    if scope.scope == "prompts":
        zero = F.lit(0).cast("bigint")
        return tables.prompts.agg(F.count(F.lit(1)).alias("prompts")).select(
            zero.alias("events"), "prompts", zero.alias("sessions"), zero.alias("projects")
        )
    doomed = tables.events.where(scope.covers())
    folded = doomed.groupBy("session_id", "project_id").agg(F.count(F.lit(1)).alias("n"))
    counts = folded.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("project_id").alias("projects"),
    )
    prompts = tables.prompts.join(doomed.select("event_id"), "event_id", "left_semi").agg(
        F.count(F.lit(1))
    )
    return counts.withColumn("prompts", prompts.scalar()).select(
        "events", "prompts", "sessions", "projects"
    )


def erase_prompt_text(tables: Tables) -> Tables:
    """Text and previews gone, responses dropped, every measure kept."""
    none = F.lit(None).cast("string")
    return tables.but(
        prompts=tables.prompts.withColumn("text", none).withColumn("preview", none),
        responses=tables.responses.where(F.lit(False)),
    )


def delete(tables: Tables, scope: DeleteScope) -> Tables:
    """Tables after a deletion. Rollups built before it must be rebuilt for the removed days.

    Side tables follow their event; projects that own no event any more disappear. Sessions are
    derived from events and need no pruning of their own.
    """
    if scope.scope == "prompts":
        return erase_prompt_text(tables)
    if scope.scope == "all":
        none = F.lit(False)
        return tables.but(
            **{
                name: df.where(none)
                for name, df in vars(tables).items()
                if df is not None and name != "providers"
            }
        )
    doomed = tables.events.where(scope.covers()).select("event_id")
    events = tables.events.where(~scope.covers())
    sides = {}
    for name in ("prompts", "responses", "tool_calls", "classifications", "technologies",
                 "contexts"):
        df = getattr(tables, name)
        if df is not None:
            sides[name] = df.join(doomed, "event_id", "left_anti")
    projects = tables.projects
    if projects is not None:
        projects = projects.join(
            events.select("project_id").distinct(), "project_id", "left_semi"
        )
    return tables.but(events=events, projects=projects, **sides)


def touched_by(tables: Tables, scope: DeleteScope) -> DataFrame:
    """(day, provider) pairs whose rollups a deletion makes stale."""
    return tables.events.where(scope.covers()).select("local_date", "provider_id").distinct()


def retention_cutoff_ms(as_of: dt.datetime, months: int) -> Column:
    """Instant ``months`` before ``as_of``, clamped to the end of a shorter month."""
    at = F.timestamp_millis(F.lit(_epoch_ms(as_of)))
    day = F.add_months(at, -months).cast("date")
    midnight = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000
    return midnight + F.lit(_epoch_ms(as_of) % 86_400_000)


def apply_retention(tables: Tables, months: int, as_of: dt.datetime) -> Tables:
    """Prompt text older than the retention cleared; zero months keeps everything."""
    if months <= 0:
        return tables
    old = tables.events.where(F.col("ts_ms") < retention_cutoff_ms(as_of, months)).select(
        "event_id", F.lit(True).alias("expired")
    )
    marked = tables.prompts.join(old, "event_id", "left")
    keep = F.col("expired").isNull()
    prompts = marked.withColumn("text", F.when(keep, F.col("text"))).withColumn(
        "preview", F.when(keep, F.col("preview"))
    )
    return tables.but(prompts=prompts.select(*tables.prompts.columns))


def expired_count(tables: Tables, months: int, as_of: dt.datetime) -> DataFrame:
    """Prompts whose text a retention pass would clear."""
    if months <= 0:
        old = tables.events.where(F.lit(False))
    else:
        old = tables.events.where(F.col("ts_ms") < retention_cutoff_ms(as_of, months))
    return (
        tables.prompts.where(F.col("text").isNotNull())
        .join(old.select("event_id"), "event_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("cleared"))
    )


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows per dataset, counted by Spark rather than one action each."""
    out = None
    for name, df in frames.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out
