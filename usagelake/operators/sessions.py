"""Session-level answers: in-window list, lifetime metrics, categories, timeline."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.contract import DEFAULT_IDLE_MS, TAIL_MS, EventFilters, Tables
from usagelake.operators.active import active_time
from usagelake.operators.filters import _epoch_ms, apply_filters
from usagelake.operators.totals import TOKENS, cost_sum, count_if, token_sums, totals


def _first_by_time(column: str) -> Column:
    """Earliest non-null value, the lowest event id on ties."""
    return F.min(
        F.when(
            F.col(column).isNotNull(),
            F.struct("ts_ms", "event_id", F.col(column).alias("value")),
        )
    )["value"]


def session_boundaries(events: DataFrame) -> DataFrame:
    """First and last instant, first model and first directory of each session in a batch."""
    return events.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.max("provider_id").alias("provider_id"),
        F.max("external_session_id").alias("external_id"),
        F.min("ts_ms").alias("started_ms"),
        F.max("ts_ms").alias("ended_ms"),
        _first_by_time("model").alias("primary_model"),
        _first_by_time("working_directory").alias("working_directory"),
        _first_by_time("project_id").alias("project_id"),
    )


def session_metrics(
    events: DataFrame, idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS
) -> DataFrame:
    """Lifetime metrics of every session, derived from its events.

    Primary model is the most frequent one, ties by name; project is the earliest known one.
    """
    inside = events.where(F.col("session_id").isNotNull())
    # Folding by model first gives the counters and the model frequencies in one shuffle of events.
    per_model = inside.groupBy("session_id", "model").agg(
        F.count(F.lit(1)).alias("events"),
        F.max("provider_id").alias("provider_id"),
        count_if("prompt").alias("prompt_count"),
        count_if("response").alias("response_count"),
        count_if("tool_call").alias("tool_count"),
        *[F.sum(c).alias(c) for c in TOKENS],
        cost_sum(),
        F.min("ts_ms").alias("started_ms"),
        F.max("ts_ms").alias("ended_ms"),
        F.min(
            F.when(F.col("project_id").isNotNull(), F.struct("ts_ms", "event_id", "project_id"))
        ).alias("first_project"),
    )
    favourite = F.min(
        F.when(
            F.col("model").isNotNull(),
            F.struct((-F.col("events")).alias("neg"), F.col("model").alias("model")),
        )
    )
    folded = per_model.groupBy("session_id").agg(
        F.max("provider_id").alias("provider_id"),
        *[F.sum(c).alias(c) for c in ("prompt_count", "response_count", "tool_count")],
        *token_sums(),
        cost_sum(),
        F.min("started_ms").alias("started_ms"),
        F.max("ended_ms").alias("ended_ms"),
        F.min("first_project")["project_id"].alias("project_id"),
        favourite["model"].alias("primary_model"),
    )
    active = active_time(inside, ["session_id"], (), idle_ms, tail_ms).drop("session_days")
    return folded.join(active, "session_id", "left").withColumn(
        "duration_ms", F.col("ended_ms") - F.col("started_ms")
    )


def merge_sessions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert of session rows: earliest start, latest end, known values kept."""
    columns = ["session_id", "provider_id", "external_id", "project_id", "started_ms", "ended_ms",
               "primary_model", "end_reason"]

    def shaped(df: DataFrame, seq: int) -> DataFrame:
        present = [
            F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns
        ]
        return df.select(*present, F.lit(seq).alias("seq"))

    def newest_known(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)

    both = shaped(stored, 0).unionByName(shaped(incoming, 1))
    return both.groupBy("session_id").agg(
        F.min_by("provider_id", "seq").alias("provider_id"),
        F.min_by("external_id", "seq").alias("external_id"),
        newest_known("project_id"),
        F.min("started_ms").alias("started_ms"),
        F.max("ended_ms").alias("ended_ms"),
        newest_known("primary_model"),
        newest_known("end_reason"),
    )


def prune_empty(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """Sessions that still own at least one event."""
    return sessions.join(events.select("session_id").distinct(), "session_id", "left_semi")


def session_list(
    tables: Tables, f: EventFilters | None = None, idle_ms: int = DEFAULT_IDLE_MS,
    tail_ms: int = TAIL_MS, limit: int | None = 50, cursor: tuple[int, str] | None = None,
    range_from: dt.datetime | None = None,
) -> DataFrame:
    """Sessions with what happened to them inside the slice, latest first.

    Every metric is counted over the events in the slice; ``started_before_range`` tells when the
    session itself began earlier. A session that switched model is listed under each of its models.
    """
    f = f or EventFilters()
    sliced = apply_filters(tables, f).where(F.col("session_id").isNotNull())
    listed = sliced.groupBy("session_id").agg(
        F.max("provider_id").alias("provider_id"),
        F.min("ts_ms").alias("started_ms"),
        F.max("ts_ms").alias("ended_ms"),
        count_if("prompt").alias("prompt_count"),
        count_if("tool_call").alias("tool_count"),
        *token_sums(("input_tokens", "output_tokens")),
        cost_sum(),
    )
    lifetime = tables.events.where(F.col("session_id").isNotNull())
    if f.provider_id:
        lifetime = lifetime.where(F.col("provider_id") == f.provider_id)
    life = lifetime.groupBy("session_id", "model").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("ts_ms").alias("first_ms"),
        F.max("external_session_id").alias("external_id"),
        F.min(
            F.when(F.col("project_id").isNotNull(), F.struct("ts_ms", "event_id", "project_id"))
        ).alias("first_project"),
    ).groupBy("session_id").agg(
        F.min("first_ms").alias("session_started_ms"),
        F.max("external_id").alias("external_id"),
        F.min("first_project")["project_id"].alias("project_id"),
        F.min(
            F.when(F.col("model").isNotNull(),
                   F.struct((-F.col("n")).alias("neg"), F.col("model").alias("model")))
        )["model"].alias("primary_model"),
    )
    joined = listed.join(life, "session_id")
    if f.project_id:
        joined = joined.where(F.col("project_id") == f.project_id)
    if cursor is not None:
        ended, last_id = cursor
        joined = joined.where(
            (F.col("ended_ms") < ended)
            | ((F.col("ended_ms") == ended) & (F.col("session_id") < last_id))
        )
    active = active_time(sliced, ["session_id"], (), idle_ms, tail_ms).drop("session_days")
    page = joined.join(active, "session_id", "left")
    if limit is not None:
        page = page.orderBy(F.desc("ended_ms"), F.desc("session_id")).limit(limit + 1)
    named = page.join(
        tables.providers.select("provider_id", F.col("name").alias("provider_name")),
        "provider_id", "left",
    ).join(
        tables.projects.select("project_id", F.col("name").alias("project_name")),
        "project_id", "left",
    )
    from_ms = _epoch_ms(range_from) if range_from else None
    before = F.lit(False) if from_ms is None else F.col("session_started_ms") < from_ms
    if limit is not None:
        named = named.orderBy(F.desc("ended_ms"), F.desc("session_id"))
    return named.select(
        "session_id", "external_id", "provider_id",
        F.coalesce("provider_name", "provider_id").alias("provider_name"),
        "project_id", "project_name", "primary_model", "started_ms", "ended_ms",
        "session_started_ms",
        (F.col("ended_ms") - F.col("started_ms")).alias("duration_ms"),
        "active_ms", "prompt_count", "tool_count", "input_tokens", "output_tokens",
        "estimated_cost_usd", before.alias("started_before_range"),
    )


def session_page_totals(
    events: DataFrame, idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS
) -> DataFrame:
    return totals(events, (), idle_ms, tail_ms).select(
        "sessions", "prompts", "active_ms", "estimated_cost_usd"
    )


def session_categories(tables: Tables, top_n: int | None = None) -> DataFrame:
    """Classified events per session and category, largest first."""
    counted = (
        tables.events.where(F.col("session_id").isNotNull())
        .select("event_id", "session_id")
        .join(tables.classifications.select("event_id", "category"), "event_id")
        .groupBy("session_id", "category")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if top_n is None:
        return counted
    # One row per category of a session: a closed domain of thirteen.
    rank = Window.partitionBy("session_id").orderBy(F.desc("count"), "category")
    return counted.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top_n)


def session_timeline(
    tables: Tables, session_id: str, limit: int | None = None,
    cursor: tuple[int, str] | None = None,
) -> DataFrame:
    """Events of one session by time with a readable label.

    With a limit, a page of that many rows; ``cursor`` is the (ts_ms, event_id) of the last row of
    the page before.
    """
    own = tables.events.where(F.col("session_id") == session_id)
    if cursor is not None:
        ts, event_id = cursor
        own = own.where(
            (F.col("ts_ms") > ts) | ((F.col("ts_ms") == ts) & (F.col("event_id") > event_id))
        )
    page = own.orderBy("ts_ms", "event_id")
    page = page if limit is None else page.limit(limit)
    days = page.select("local_date").distinct()

    def side(df: DataFrame, *columns: str) -> DataFrame:
        return df.join(days, "local_date", "left_semi").select("event_id", *columns)

    return (
        page.join(side(tables.tool_calls, "tool_name"), "event_id", "left")
        .join(side(tables.classifications, "category"), "event_id", "left")
        .join(side(tables.prompts, "preview"), "event_id", "left")
        .select(
            "event_id", "ts_ms", "event_type",
            F.coalesce("preview", "tool_name", "event_type").alias("label"),
            "model", "tool_name", "category", "is_subagent",
        )
    )


def session_detail(
    tables: Tables, session_id: str, idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS
) -> dict[str, DataFrame]:
    """Lifetime metrics, category counts and timeline of one session."""
    one = tables.but(events=tables.events.where(F.col("session_id") == session_id))
    return {
        "summary": session_metrics(one.events, idle_ms, tail_ms),
        "categories": session_categories(one),
        "timeline": session_timeline(one, session_id),
    }


def day_sections(sessions: DataFrame, timezone_offset_minutes: int = 0) -> DataFrame:
    """Session list folded by the day each session started."""
    shifted = F.col("started_ms") + F.lit(timezone_offset_minutes * 60_000)
    day = F.date_add(
        F.lit("1970-01-01").cast("date"), F.floor(shifted / F.lit(86_400_000)).cast("int")
    )
    return sessions.groupBy(day.alias("day")).agg(
        F.count(F.lit(1)).alias("sessions"),
        F.sum("prompt_count").alias("prompts"),
        F.sum("active_ms").alias("active_ms"),
    )
