"""The overview: everything a period is summarised by, as named DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.contract import EventFilters, Tables
from usagelake.functions import measures
from usagelake.functions.exprs import js_round
from usagelake.functions.ids import is_real_model
from usagelake.operators import rollups as ru
from usagelake.operators import totals as tt
from usagelake.operators.active import active_by_day, active_time
from usagelake.operators.filters import apply_filters
from usagelake.plans.scope import Scope


def _span(f: EventFilters) -> Column:
    day = F.col("local_date")
    return (day >= F.lit(f.from_day).cast("date")) & (day <= F.lit(f.to_day).cast("date"))


def _daily(tables: Tables, scope: Scope, f: EventFilters) -> DataFrame | None:
    """Active time per day and provider as the rollups hold it, taken from the log.

    A gap counts on the day of its later event, also where the earlier one lies before the period,
    so the history of the sessions seen is read. ``None`` where rollups could not answer: then
    active time is that of the slice alone.
    """
    if not (ru.rollups_can_answer(f) and ru.active_can_answer(f)):
        return None
    days = apply_filters(tables, f).select("local_date", "provider_id").distinct()
    s = scope.settings
    return ru.daily_active(tables.events, days, s.idle_ms, s.tail_ms)


def period_totals(tables: Tables, scope: Scope, rollups: DataFrame | None = None,
                  active: DataFrame | None = None) -> DataFrame:
    """Totals of the current and the previous period, one row each, keyed by ``period``.

    From the log both periods are read in one scan. From rollups the counters come from the daily
    rows, while distinct sessions still come from the log, and so does active time when the filter
    names a dimension the daily active time lacks. Either way gives the same rows.
    """
    periods = F.when(_span(scope.filters), "current").when(_span(scope.previous), "previous")
    both = scope.filters.but(from_day=scope.previous.from_day)
    s = scope.settings
    if not (scope.use_rollups and rollups is not None and active is not None):
        events = apply_filters(tables, both).withColumn("period", periods)
        daily = _daily(tables, scope, both)
        if daily is None:
            found = tt.totals(events, ["period"], s.idle_ms, s.tail_ms)
        else:
            spent = daily.withColumnRenamed("day", "local_date").groupBy(periods.alias("period")).agg(
                F.sum("active_ms").alias("active_ms"))
            found = tt.counters(events, ["period"]).join(spent, "period", "left")
        axis = tables.events.sparkSession.createDataFrame(
            [("current",), ("previous",)], "period string"
        )
        out = axis.join(found, "period", "left")
        zero = [c for c in out.columns if c not in ("period", "estimated_cost_usd")]
        return out.fillna(0, zero)
    frames = []
    for name, f in (("current", scope.filters), ("previous", scope.previous)):
        row = ru.rollup_totals(rollups, active, f)
        if not ru.active_can_answer(f):
            sliced = apply_filters(tables, f)
            total = active_time(sliced, (), (), s.idle_ms, s.tail_ms).select("active_ms")
            row = row.withColumn("active_ms", total.scalar())
        distinct = ru.exact_distincts(tables, rollups, f)
        row = row.withColumn("sessions", distinct.select("sessions").scalar()).withColumn(
            "projects", distinct.select("projects").scalar()
        )
        frames.append(row.withColumn("period", F.lit(name)))
    return frames[0].unionByName(frames[1])


def period_summary(both: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """One row: each headline metric with its previous value and change."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    billable = tokens + F.col("cache_read_tokens") + F.col("cache_write_tokens")
    shaped = both.withColumn("tokens", tokens).withColumn("billable_tokens", billable)
    metrics = ("prompts", "sessions", "active_ms", "tokens", "tool_calls", "billable_tokens")

    def of(period: str, column: str) -> Column:
        return F.max(F.when(F.col("period") == period, F.col(column)))

    aggregates = []
    for m in (*metrics, "estimated_cost_usd"):
        aggregates += [of("current", m).alias(m), of("previous", m).alias(f"{m}_previous")]
    for m in (*tt.TOKENS, "projects", "events"):
        aggregates.append(of("current", m).alias(m))
    row = shaped.agg(*aggregates)
    for m in metrics:
        row = row.withColumn(
            f"{m}_change_pct", measures.change_pct(F.col(m), F.col(f"{m}_previous"))
        )
    out = (
        row.withColumn(
            "estimated_cost_usd_change_pct",
            measures.cost_change_pct(
                F.col("estimated_cost_usd"), F.col("estimated_cost_usd_previous")
            ),
        )
        .withColumn("prompts_per_session", measures.ratio(F.col("prompts"), F.col("sessions")))
        .withColumn(
            "ms_per_session",
            F.when(
                F.col("sessions") > 0,
                js_round(F.col("active_ms") / F.nullif(F.col("sessions"), F.lit(0))),
            ).otherwise(F.lit(0)),
        )
        .withColumn(
            "cache_reuse",
            measures.cache_reuse(
                F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens")
            ),
        )
    )
    if points is not None:
        best = tt.busiest_bucket(points)
        out = out.withColumn("busiest_bucket", best.select("bucket").scalar()).withColumn(
            "busiest_bucket_prompts", best.select("prompts").scalar()
        )
    return out


def timeline(tables: Tables, scope: Scope, rollups: DataFrame | None = None,
             active: DataFrame | None = None) -> DataFrame:
    """Buckets of the current period at the scope's granularity."""
    s, f = scope.settings, scope.filters
    if not (scope.use_rollups and rollups is not None and active is not None):
        sliced, daily = apply_filters(tables, f), _daily(tables, scope, f)
        if scope.granularity != "day" or daily is None:
            return tt.timeseries(sliced, scope.granularity, s.idle_ms, s.tail_ms)
        spent = daily.groupBy(F.col("day").cast("string").alias("bucket")).agg(
            F.sum("active_ms").alias("active_ms"))
        return tt.buckets(sliced, "day").join(spent, "bucket", "left").withColumn(
            "active_ms", F.coalesce("active_ms", F.lit(0)))
    points = ru.rollup_buckets(rollups, active, f, scope.granularity == "week")
    if scope.granularity != "day":
        # A session of two days of a week is one session, so the log is asked.
        exact = tt.buckets(apply_filters(tables, f), scope.granularity).select("bucket", "sessions")
        return points.drop("sessions").join(exact, "bucket", "left").withColumn(
            "active_ms", F.lit(0).cast("bigint"))
    by_day = ru.rollup_active_by_day(active, f)
    if by_day is None:
        by_day = active_by_day(apply_filters(tables, f), s.idle_ms, s.tail_ms).select(
            F.col("local_date").alias("day"), "active_ms"
        )
    keyed = by_day.select(F.col("day").cast("string").alias("bucket"), "active_ms")
    return points.join(keyed, "bucket", "left").withColumn(
        "active_ms", F.coalesce("active_ms", F.lit(0))
    )


def subscription_value(both: DataFrame, plans: DataFrame, days: float) -> DataFrame:
    """Prorated fee of each plan and how many times over the metered price covers it.

    ``plans(provider_id, monthly_usd)`` and ``both(provider_id, estimated_cost_usd)``.
    """
    return plans.join(both, "provider_id", "left").select(
        "provider_id", "monthly_usd", "estimated_cost_usd",
        measures.prorated_fee(F.col("monthly_usd"), F.lit(float(days))).alias("period_usd"),
    ).withColumn("leverage", F.col("estimated_cost_usd") / F.nullif("period_usd", F.lit(0.0)))


#: What the page breaks a period down by.
PARTS = ("day", "provider_id", "project_id", "model", "category")


def page_counts(rollups: DataFrame, scope: Scope) -> DataFrame:
    """All counters of the page from one aggregation of the rollups: part, key, period and sums.

    Part ``total`` has the periods, the others one row per period and day, provider, project, model
    or category; a null key is one of its own. A part of the page is a slice of this frame, so
    whoever keeps it (it has as many rows as the page names keys) reads the rollups once. Distinct
    sessions are not sums and come from elsewhere.
    """
    both = scope.filters.but(from_day=scope.previous.from_day)
    current = F.col("day") >= F.lit(scope.filters.from_day).cast("date")
    everything = F.col("prompts") + F.col("responses") + F.col("tool_calls") + F.col("other_events")
    rows = ru.sliced(rollups, both).withColumn("period", F.when(current, "current").otherwise("previous"))
    sets = [["period"], *[["period", part] for part in PARTS]]
    counts = [F.sum(c).alias(c) for c in ("prompts", "responses", "tool_calls", "confidence_sum", "confidences")]
    grouped = rows.groupingSets(
        [[F.col(c) for c in s] for s in sets], "period", *PARTS
    ).agg(*counts, F.sum(everything).alias("events"), *tt.token_sums(), tt.cost_sum(),
          *[F.grouping(part).alias(f"_{part}") for part in PARTS])
    part, key = F.lit("total"), F.lit(None).cast("string")
    for name in PARTS:
        part = F.when(F.col(f"_{name}") == 0, name).otherwise(part)
        key = F.when(F.col(f"_{name}") == 0, F.col(name).cast("string")).otherwise(key)
    return grouped.select(
        part.alias("part"), key.alias("key"), "period", "prompts", "responses", "tool_calls", "events",
        *tt.TOKENS, "estimated_cost_usd", "confidence_sum", "confidences")


def page_part(counts: DataFrame, part: str, total: Column | None = None) -> DataFrame:
    """Keys of one part in the current period with their count and share, largest first: replies of
    real models, prompts of everything else."""
    count = F.col("responses" if part == "model" else "prompts")
    rows = counts.where((F.col("part") == part) & (F.col("period") == "current") & (count > 0))
    key = F.coalesce("key", F.lit("Other")) if part == "category" else F.col("key")
    named = rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.sum(count).alias("count"))
    if part == "model":
        named = named.where(is_real_model(F.col("key")))
    return tt.with_share(tt.top(named, None), total=total)


def overview(
    tables: Tables, scope: Scope, rollups: DataFrame | None = None,
    active: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The whole page, from the log or from the rollups as the scope decides."""
    f = scope.filters
    routed = scope.use_rollups and rollups is not None and active is not None
    both = period_totals(tables, scope, rollups, active)
    points = timeline(tables, scope, rollups, active)
    prompt_total = both.where(F.col("period") == "current").select("prompts").scalar()
    if routed:
        sources = ru.rollup_by(rollups, "provider_id", f, tables.providers)
        categories = ru.rollup_categories(rollups, f)
        projects = ru.rollup_by(rollups, "project_id", f, tables.projects, 8)
        models = ru.rollup_models(rollups, f)
    else:
        sources = tt.by_provider(tables, f).where(F.col("count") > 0)
        categories = tt.by_category(tables, f)
        projects = tt.by_project(tables, f, 8)
        models = tt.top(
            tt.by_model(apply_filters(tables, f)).select(
                F.col("model").alias("key"), F.col("responses").alias("count")
            ), None,
        )
    models = models.where(is_real_model(F.col("key")) & (F.col("count") > 0))
    return {
        "period": period_summary(both, points),
        "sources": tt.with_share(sources, total=prompt_total),
        "categories": tt.with_share(categories, total=prompt_total),
        "projects": tt.with_share(projects, total=prompt_total),
        "technologies": tt.with_share(tt.by_technology(tables, f, 10), total=prompt_total),
        "models": tt.top(tt.with_share(models), 8),
        "timeline": points,
    }
