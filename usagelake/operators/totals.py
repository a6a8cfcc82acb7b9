"""Counters over the event log: totals, buckets and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.contract import DEFAULT_IDLE_MS, TAIL_MS, EventFilters, Tables
from usagelake.functions import measures, timeutil
from usagelake.functions.ids import is_real_model
from usagelake.operators.active import active_by_day, active_time
from usagelake.operators.filters import apply_filters, prune

TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def count_if(kind: str) -> Column:
    return F.count(F.when(F.col("event_type") == kind, 1))


def token_sums(columns: Sequence[str] = TOKENS) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]


def cost_sum() -> Column:
    """Not coalesced: a group with no priced model is unknown, not free.

    Costs are whole millionths, so they are added as integers: the same total whatever order the
    partitions arrive in.
    """
    micros = F.sum(F.round(F.col("estimated_cost_usd") * 1_000_000.0).cast("bigint"))
    return (micros / F.lit(1_000_000.0)).alias("estimated_cost_usd")


def counters(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Event counters with distinct sessions and projects.

    Two exact distinct counts in one aggregate would expand every event three times before the
    shuffle. Folding to (session, project) first, with a map-side combine, leaves a small frame
    for the distinct counts.
    """
    folded = events.groupBy(*by, "session_id", "project_id").agg(
        F.count(F.lit(1)).alias("events"),
        count_if("prompt").alias("prompts"),
        count_if("response").alias("responses"),
        count_if("tool_call").alias("tool_calls"),
        *[F.sum(c).alias(c) for c in TOKENS],
        cost_sum(),
    )
    counts = [
        F.coalesce(F.sum(c), F.lit(0)).alias(c)
        for c in ("events", "prompts", "responses", "tool_calls")
    ]
    return folded.groupBy(*by).agg(
        *counts,
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("project_id").alias("projects"),
        *token_sums(),
        cost_sum(),
    )


def totals(
    events: DataFrame, by: Sequence[str] = (), idle_ms: int = DEFAULT_IDLE_MS,
    tail_ms: int = TAIL_MS,
) -> DataFrame:
    """One row of totals per ``by`` group, active time included.

    With ``by`` the sequence of events restarts per group, as if each were asked about alone.
    """
    counted = counters(events, by)
    active = active_time(events, by, by, idle_ms, tail_ms).drop("session_days")
    if by:
        joined = counted.join(active, list(by), "left")
    else:
        # Both sides are one row; the scalar becomes a literal instead of a join.
        joined = counted.withColumn("active_ms", active.scalar())
    return joined.withColumn("active_ms", F.coalesce("active_ms", F.lit(0)))


def buckets(events: DataFrame, granularity: str) -> DataFrame:
    """Counters per local hour, day or week that has events; gaps are not filled."""
    key = timeutil.bucket(granularity, F.col("local_date"), F.col("local_hour"))
    return events.groupBy(key.alias("bucket")).agg(
        count_if("prompt").alias("prompts"),
        F.count_distinct("session_id").alias("sessions"),
        *token_sums(("input_tokens", "output_tokens")),
        cost_sum(),
    )


def timeseries(
    events: DataFrame, granularity: str, idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS
) -> DataFrame:
    """Buckets with active time, which is reported at day grain only."""
    points = buckets(events, granularity)
    if granularity != "day":
        return points.withColumn("active_ms", F.lit(0).cast("bigint"))
    active = active_by_day(events, idle_ms, tail_ms).select(
        F.col("local_date").cast("string").alias("bucket"), "active_ms"
    )
    return points.join(active, "bucket", "left").withColumn(
        "active_ms", F.coalesce("active_ms", F.lit(0))
    )


def top(df: DataFrame, limit: int | None, key: str = "key", count: str = "count") -> DataFrame:
    """Largest counts first, ties by key."""
    ordered = df.orderBy(F.desc(count), F.asc(key))
    return ordered.limit(limit) if limit else ordered


def with_share(df: DataFrame, count: str = "count", total: Column | None = None) -> DataFrame:
    """Share of the column's own total, or of a given one, in percent."""
    if total is None:
        total = df.agg(F.sum(count)).scalar()
    return df.withColumn("share", measures.share(F.col(count), total))


def by_provider(tables: Tables, f: EventFilters | None = None) -> DataFrame:
    """Prompts per provider; one with events but no prompts is still listed."""
    counted = apply_filters(tables, f).groupBy(F.col("provider_id").alias("key")).agg(
        count_if("prompt").alias("count")
    )
    names = tables.providers.select(F.col("provider_id").alias("key"), "name")
    # Counted first, named after: the dimension meets one row per provider, not every event.
    return counted.join(names, "key", "left").select(
        "key", F.coalesce("name", "key").alias("name"), "count"
    )


def by_category(tables: Tables, f: EventFilters | None = None,
                by: Sequence[str] = ()) -> DataFrame:
    """Prompts per category; a prompt with no classification counts as Other."""
    tables = prune(tables, f)
    prompts = apply_filters(tables, f, event_type="prompt")
    return category_counts(prompts, tables.classifications, by)


def category_counts(prompts: DataFrame, classifications: DataFrame,
                    by: Sequence[str] = ()) -> DataFrame:
    labelled = prompts.join(
        classifications.select("event_id", "category", "confidence"), "event_id", "left"
    )
    return labelled.groupBy(*by, F.coalesce("category", F.lit("Other")).alias("key")).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
    )


def categories(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Categories of the current period with their share then and now, both from counted rows."""
    prior = previous.select("key", F.col("count").alias("prior"))
    prior_total = previous.agg(F.coalesce(F.sum("count"), F.lit(0))).scalar()
    aligned = with_share(current).join(prior, "key", "left")
    return aligned.select(
        F.col("key").alias("category"),
        F.col("count").alias("prompts"),
        "share",
        (F.floor(F.col("avg_confidence") * 100 + 0.5) / 100).alias("avg_confidence"),
        F.when(
            prior_total > 0, measures.share(F.coalesce("prior", F.lit(0)), prior_total)
        ).alias("previous_share"),
    )


def by_project(tables: Tables, f: EventFilters | None = None, limit: int | None = None) -> DataFrame:
    counted = (
        apply_filters(tables, f, event_type="prompt")
        .where(F.col("project_id").isNotNull())
        .groupBy(F.col("project_id").alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    names = tables.projects.select(F.col("project_id").alias("key"), "name")
    named = top(counted, limit).join(names, "key", "left").select(
        "key", F.coalesce("name", F.lit("Unknown")).alias("name"), "count"
    )
    return top(named, None)


def by_technology(tables: Tables, f: EventFilters | None = None, limit: int | None = None) -> DataFrame:
    """Prompt and technology pairs counted once each."""
    tables = prune(tables, f)
    prompts = apply_filters(tables, f, event_type="prompt").select("event_id")
    counted = (
        prompts.join(tables.technologies.select("event_id", "technology"), "event_id")
        .groupBy(F.col("technology").alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return top(counted, limit)


def by_context(
    tables: Tables, f: EventFilters | None = None, technology: str | None = None
) -> DataFrame:
    tables = prune(tables, f)
    prompts = apply_filters(tables, f, event_type="prompt").select("event_id")
    if technology:
        wanted = tables.technologies.where(F.col("technology") == technology)
        prompts = prompts.join(wanted.select("event_id"), "event_id", "left_semi")
    return (
        prompts.join(tables.contexts.select("event_id", "context"), "event_id")
        .groupBy(F.col("context").alias("key"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def technology_contexts(
    tables: Tables, f: EventFilters | None = None, limit: int | None = None, top_contexts: int = 4
) -> DataFrame:
    """Technologies with the task areas they were used in, in one pass over the pairs."""
    tables = prune(tables, f)
    prompts = apply_filters(tables, f, event_type="prompt").select("event_id")
    techs = prompts.join(tables.technologies.select("event_id", "technology"), "event_id")
    counted = top(
        techs.groupBy(F.col("technology").alias("key")).agg(F.count(F.lit(1)).alias("count")),
        limit,
    )
    pairs = (
        techs.join(tables.contexts.select("event_id", "context"), "event_id")
        .groupBy("technology", "context")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # At most one row per task area and technology reaches the window.
    rank = Window.partitionBy("technology").orderBy(F.desc("n"), "context")
    best = (
        pairs.withColumn("place", F.row_number().over(rank))
        .where(F.col("place") <= top_contexts)
        .groupBy(F.col("technology").alias("key"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "context", "n"))).alias("areas"))
    )
    return with_share(counted).join(best, "key", "left").select(
        F.col("key").alias("technology"), F.col("count").alias("prompts"), "share",
        F.coalesce(
            F.transform("areas", lambda a: F.struct(a["context"], a["n"].alias("count"))),
            F.array().cast("array<struct<context:string,count:bigint>>"),
        ).alias("contexts"),
    ).orderBy(F.desc("prompts"), "technology")


def by_model(events: DataFrame) -> DataFrame:
    return (
        events.where(F.col("model").isNotNull())
        .groupBy("model")
        .agg(
            F.max("model_family").alias("model_family"),
            F.count(F.lit(1)).alias("events"),
            count_if("prompt").alias("prompts"),
            count_if("response").alias("responses"),
            *token_sums(),
            cost_sum(),
        )
    )


def models(events: DataFrame) -> DataFrame:
    """Real models with their share of events."""
    return with_share(by_model(events).where(is_real_model(F.col("model"))), "events")


def active_hours(prompts: DataFrame) -> DataFrame:
    """Prompts per local hour, all 24 present."""
    counted = prompts.groupBy(F.col("local_hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("prompts")
    )
    return _filled(prompts, counted, "hour", 24)


def active_weekdays(prompts: DataFrame) -> DataFrame:
    """Prompts per local weekday, all 7 present, 0 = Sunday."""
    counted = prompts.groupBy(F.col("local_weekday").alias("weekday")).agg(
        F.count(F.lit(1)).alias("prompts")
    )
    return _filled(prompts, counted, "weekday", 7)


def _filled(df: DataFrame, counted: DataFrame, key: str, slots: int) -> DataFrame:
    axis = df.sparkSession.range(slots).select(F.col("id").cast("int").alias(key))
    return axis.join(counted, key, "left").select(
        key, F.coalesce("prompts", F.lit(0)).alias("prompts")
    )


def peak_window(hours: DataFrame, width: int = 3) -> DataFrame:
    """Busiest contiguous hours around the clock, the earliest start on ties; no row if empty."""
    clock = hours.groupBy().agg(
        F.map_from_entries(F.collect_list(F.struct("hour", "prompts"))).alias("clock"),
        F.sum("prompts").alias("total"),
    )
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(23)),
        lambda h: F.struct(
            F.aggregate(
                F.sequence(F.lit(0), F.lit(width - 1)), F.lit(0).cast("bigint"),
                lambda acc, o: acc + F.coalesce(
                    F.try_element_at("clock", ((h + o) % 24).cast("int")), F.lit(0)
                ),
            ).alias("prompts"),
            (-h).alias("neg_start"),
        ),
    )
    best = clock.where(F.col("total") > 0).select(F.array_max(starts).alias("best"))
    return best.select(
        (-F.col("best.neg_start")).alias("from_hour"),
        ((-F.col("best.neg_start") + width) % 24).alias("to_hour"),
        F.col("best.prompts").alias("prompts"),
    )


def busiest_bucket(points: DataFrame) -> DataFrame:
    """Bucket with the most prompts, the earliest on ties; no row when nothing was asked."""
    return points.where(F.col("prompts") > 0).orderBy(F.desc("prompts"), "bucket").limit(1).select(
        "bucket", "prompts"
    )


def first_event(events: DataFrame) -> DataFrame:
    return events.agg(F.min("ts_ms").alias("first_event_ms"))


def provider_activity(events: DataFrame) -> DataFrame:
    return events.groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.max("ts_ms").alias("last_event_ms")
    )


def provider_summary(tables: Tables) -> DataFrame:
    """Every provider with what it sent; a paused one keeps its row."""
    known = tables.providers.select("provider_id", "name", "enabled")
    return known.join(provider_activity(tables.events), "provider_id", "left").select(
        "provider_id", "name", "enabled",
        F.when(F.col("enabled"), "connected").otherwise("paused").alias("status"),
        F.coalesce("event_count", F.lit(0)).alias("event_count"), "last_event_ms",
    )


def touch_last_event(providers: DataFrame, events: DataFrame) -> DataFrame:
    """Provider dimension with its last event moved forward, never back."""
    seen = events.groupBy("provider_id").agg(F.max("ts_ms").alias("batch_last_ms"))
    return providers.join(seen, "provider_id", "left").withColumn(
        "last_event_ms", F.greatest("last_event_ms", "batch_last_ms")
    ).drop("batch_last_ms")
