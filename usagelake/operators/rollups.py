"""Daily rollups: building them, keeping them fresh, and answering questions from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.contract import DEFAULT_IDLE_MS, TAIL_MS, EventFilters, Tables
from usagelake.functions import timeutil
from usagelake.operators.active import active_by_day
from usagelake.operators.filters import apply_filters, event_predicate
from usagelake.operators.totals import cost_sum, count_if, token_sums, top

DIMENSIONS = ("provider_id", "project_id", "model", "category")


def _only(df: DataFrame, touched: DataFrame | None) -> DataFrame:
    if touched is None:
        return df
    return df.join(
        touched.select("local_date", "provider_id").distinct(),
        ["local_date", "provider_id"], "left_semi",
    )


def daily_rollups(tables: Tables, touched: DataFrame | None = None) -> DataFrame:
    """Counters per (day, provider, project, model, category), nulls kept as nulls.

    ``confidences`` counts classified rows beside the confidence sum, so an average over any
    re-aggregation matches the one taken from the log. ``touched`` limits the build to those
    (day, provider) pairs.
    """
    events = _only(tables.events, touched)
    labelled = events.join(
        tables.classifications.select("event_id", "category", "confidence"), "event_id", "left"
    )
    other = F.count(F.when(~F.col("event_type").isin("prompt", "response", "tool_call"), 1))
    return labelled.groupBy(
        F.col("local_date").alias("day"), "provider_id", "project_id", "model", "category"
    ).agg(
        count_if("prompt").alias("prompts"),
        count_if("response").alias("responses"),
        count_if("tool_call").alias("tool_calls"),
        other.alias("other_events"),
        F.count_distinct("session_id").alias("sessions"),
        *token_sums(),
        cost_sum(),
        F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("confidence_sum"),
        F.count("confidence").alias("confidences"),
    )


def daily_active(
    events: DataFrame, touched: DataFrame | None = None,
    idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS,
) -> DataFrame:
    """Active time and sessions per (day, provider).

    Gaps follow the whole history of a session: the event before the first one of a rebuilt day
    usually lies on the day before. With ``touched`` only sessions seen on those days are read,
    and only those days come out.
    """
    source = events.where(F.col("session_id").isNotNull())
    if touched is not None:
        sessions = _only(source, touched).select("session_id", "provider_id").distinct()
        source = source.join(sessions, ["session_id", "provider_id"], "left_semi")
    days = active_by_day(source, idle_ms, tail_ms, ["provider_id"])
    return _only(days, touched).select(
        F.col("local_date").alias("day"), "provider_id", "active_ms", "sessions"
    )


def needs_rebuild(events: DataFrame, rollups: DataFrame) -> DataFrame:
    """One row telling whether the log holds events the rollups do not describe at all."""
    has_events = events.limit(1).agg(F.count(F.lit(1)).alias("n"))
    has_rollups = rollups.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return has_events.select(
        ((F.col("n") > 0) & (has_rollups.scalar() == 0)).alias("needs_rebuild")
    )


def stale_days(events: DataFrame, rollups: DataFrame | None, fingerprint: str) -> DataFrame:
    """(day, provider) pairs of the log whose rollups are missing or of other settings.

    ``rollups`` keep the fingerprint of the settings they were built under in ``settings``.
    """
    pairs = events.select("local_date", "provider_id").distinct()
    if rollups is None or "settings" not in rollups.columns:
        return pairs
    fresh = rollups.where(F.col("settings") == fingerprint).select(
        F.col("day").alias("local_date"), "provider_id"
    ).distinct()
    return pairs.join(fresh, ["local_date", "provider_id"], "left_anti")


def covered_days(active: DataFrame) -> DataFrame:
    return active.agg(F.count(F.lit(1)).alias("covered_days"))


def rollups_can_answer(f: EventFilters) -> bool:
    """Rollups carry no technology, event type or sub-agent dimension."""
    return not f.technology and not f.event_type and f.include_subagents is not False


def active_can_answer(f: EventFilters) -> bool:
    """Active time is kept per day and provider only."""
    return not (f.project_id or f.model or f.category)


def _days(f: EventFilters, column: str = "day") -> Column:
    clause = F.lit(True)
    if f.from_day:
        clause = clause & (F.col(column) >= F.lit(f.from_day).cast("date"))
    if f.to_day:
        clause = clause & (F.col(column) <= F.lit(f.to_day).cast("date"))
    return clause


def sliced(rollups: DataFrame, f: EventFilters) -> DataFrame:
    out = rollups.where(_days(f))
    for column in DIMENSIONS:
        value = getattr(f, column)
        if value:
            out = out.where(F.col(column) == value)
    return out


def _active_slice(active: DataFrame, f: EventFilters) -> DataFrame:
    out = active.where(_days(f))
    return out.where(F.col("provider_id") == f.provider_id) if f.provider_id else out


def rollup_totals(rollups: DataFrame, active: DataFrame, f: EventFilters) -> DataFrame:
    """Totals of a span; ``active_ms`` is null when the filter names a dimension it lacks."""
    counts = [
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompts", "responses", "tool_calls")
    ]
    everything = F.col("prompts") + F.col("responses") + F.col("tool_calls") + F.col("other_events")
    out = sliced(rollups, f).agg(
        *counts, F.coalesce(F.sum(everything), F.lit(0)).alias("events"), *token_sums(), cost_sum()
    )
    if not active_can_answer(f):
        return out.withColumn("active_ms", F.lit(None).cast("bigint"))
    total = _active_slice(active, f).agg(F.coalesce(F.sum("active_ms"), F.lit(0)))
    return out.withColumn("active_ms", total.scalar())


def rollup_active_by_day(active: DataFrame, f: EventFilters) -> DataFrame | None:
    """Active time per day, or ``None`` when only the log can answer."""
    if not active_can_answer(f):
        return None
    return _active_slice(active, f).groupBy("day").agg(F.sum("active_ms").alias("active_ms"))


def rollup_buckets(
    rollups: DataFrame, active: DataFrame, f: EventFilters, weekly: bool = False
) -> DataFrame:
    """Counters per day or week.

    ``sessions`` sums the daily counts (a session on two days of a week counts on both); it is 0
    when the filter names a dimension the daily counts lack.
    """
    grain = "week" if weekly else "day"
    key = timeutil.bucket(grain, F.col("day"), F.lit(0)).alias("bucket")
    out = sliced(rollups, f).groupBy(key).agg(
        F.sum("prompts").alias("prompts"),
        *token_sums(("input_tokens", "output_tokens")),
        cost_sum(),
    )
    if not active_can_answer(f):
        return out.withColumn("sessions", F.lit(0).cast("bigint"))
    sessions = _active_slice(active, f).groupBy(key).agg(F.sum("sessions").alias("sessions"))
    return out.join(sessions, "bucket", "left").withColumn(
        "sessions", F.coalesce("sessions", F.lit(0))
    )


def rollup_by(
    rollups: DataFrame, dimension: str, f: EventFilters, names: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Prompts per provider, project, model or category, without empty groups."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension!r}")
    counted = (
        sliced(rollups, f)
        .where(F.col(dimension).isNotNull())
        .groupBy(F.col(dimension).alias("key"))
        .agg(F.sum("prompts").alias("count"))
        .where(F.col("count") > 0)
    )
    page = top(counted, limit)
    if names is None:
        return page.select("key", F.col("key").alias("name"), "count")
    named = names.select(F.col(dimension).alias("key"), "name")
    return top(
        page.join(named, "key", "left").select(
            "key", F.coalesce("name", "key").alias("name"), "count"
        ), None,
    )


def rollup_models(rollups: DataFrame, f: EventFilters, limit: int | None = None) -> DataFrame:
    """Replies per model: the reply, not the prompt, is what names the model."""
    counted = (
        sliced(rollups, f)
        .where(F.col("model").isNotNull())
        .groupBy(F.col("model").alias("key"))
        .agg(F.sum("responses").alias("count"))
        .where(F.col("count") > 0)
    )
    return top(counted, limit)


def rollup_categories(rollups: DataFrame, f: EventFilters) -> DataFrame:
    """Prompts per category with the mean confidence of the classified ones."""
    return (
        sliced(rollups, f)
        .groupBy(F.coalesce("category", F.lit("Other")).alias("key"))
        .agg(
            F.sum("prompts").alias("count"),
            F.coalesce(
                F.sum("confidence_sum") / F.nullif(F.sum("confidences"), F.lit(0)), F.lit(0.0)
            ).alias("avg_confidence"),
        )
        .where(F.col("count") > 0)
    )


def exact_distincts(tables: Tables, rollups: DataFrame, f: EventFilters) -> DataFrame:
    """Distinct sessions from the log and distinct projects from the rollups, as one row."""
    sessions = apply_filters(tables, f).agg(F.count_distinct("session_id").alias("sessions"))
    projects = sliced(rollups, f).agg(F.count_distinct("project_id"))
    return sessions.withColumn("projects", projects.scalar())


def weekly_sessions(events: DataFrame, f: EventFilters) -> DataFrame:
    """Exact distinct sessions per week, from the log."""
    return (
        events.where(event_predicate(f))
        .groupBy(timeutil.week_bucket(F.col("local_date")).alias("bucket"))
        .agg(F.count_distinct("session_id").alias("sessions"))
    )


