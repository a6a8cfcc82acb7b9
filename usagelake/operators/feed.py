"""Activity feed: keyset pages and the folding of machine turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from usagelake.contract import EventFilters, Tables
from usagelake.operators.filters import after_cursor, apply_filters, prune


def activity(
    tables: Tables, f: EventFilters | None = None, limit: int = 50,
    cursor: tuple[int, str] | None = None,
) -> DataFrame:
    """Page of events, newest first; ``limit + 1`` rows so the caller sees whether more follow.

    The page is cut before anything is joined, and each side table is narrowed to the page, so the
    five lookups cost a pass over two columns instead of five joins of the whole log.
    """
    tables = prune(tables, f)
    events = apply_filters(tables, f)
    if cursor is not None:
        events = events.where(after_cursor(*cursor))
    page = events.orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(limit + 1)
    ids = page.select("event_id")

    def side(df: DataFrame, *columns) -> DataFrame:
        return df.select("event_id", *columns).join(ids, "event_id", "left_semi")

    return (
        page.join(
            tables.providers.select("provider_id", F.col("name").alias("provider_name")),
            "provider_id", "left",
        )
        .join(
            tables.projects.select("project_id", F.col("name").alias("project_name")),
            "project_id", "left",
        )
        .join(
            side(tables.classifications, "category",
                 F.col("confidence").alias("category_confidence")),
            "event_id", "left",
        )
        .join(side(tables.prompts, "preview"), "event_id", "left")
        .join(side(tables.tool_calls, "tool_name"), "event_id", "left")
        .select(
            "event_id", "ts_ms", "local_date", "event_type", "provider_id",
            F.coalesce("provider_name", "provider_id").alias("provider_name"), "model",
            "project_id", "project_name", "session_id", "category", "category_confidence",
            "preview", "tool_name", "input_tokens", "output_tokens", "is_subagent",
        )
        .orderBy(F.desc("ts_ms"), F.desc("event_id"))
    )


def next_cursor(page: DataFrame, limit: int) -> DataFrame:
    """Cursor of the last shown row, no row when the page is the last one."""
    w = Window.orderBy(F.desc("ts_ms"), F.desc("event_id"))
    numbered = page.select("ts_ms", "event_id").withColumn("place", F.row_number().over(w))
    more = numbered.where(F.col("place") == limit + 1).select(F.lit(True).alias("more"))
    return (
        numbered.where(F.col("place") == limit).withColumn("more", more.scalar())
        .where("more").select("ts_ms", "event_id")
    )


def fold_feed(page: DataFrame, local_days: bool = True) -> DataFrame:
    """Feed entries of one page: day headers, prompts and errors, and folded machine turns.

    A run of consecutive machine events between two prompts or errors of a day becomes one entry
    with its replies, its tool calls and the first three distinct tool names. A run of one stays an
    item. The windows are global because a page is: at most ``limit + 1`` rows by construction.
    """
    day = F.col("local_date") if local_days else F.date_add(
        F.lit("1970-01-01").cast("date"), F.floor(F.col("ts_ms") / 86_400_000).cast("int")
    )
    feed = Window.orderBy(F.desc("ts_ms"), F.desc("event_id"))
    alone = F.col("event_type").isin("prompt", "error")
    marked = (
        page.withColumn("day", day)
        .withColumn("place", F.row_number().over(feed))
        .withColumn("alone", alone)
        .withColumn("new_day", ~F.col("day").eqNullSafe(F.lag("day").over(feed)))
        .withColumn("after_alone", F.coalesce(F.lag("alone").over(feed), F.lit(True)))
    )
    starts = F.col("alone") | F.col("new_day") | F.col("after_alone")
    running = feed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = marked.withColumn("run", F.sum(starts.cast("int")).over(running))
    named = F.when(
        (F.col("event_type") == "tool_call") & F.col("tool_name").isNotNull(),
        F.struct("place", "tool_name"),
    )
    entries = runs.groupBy("run").agg(
        F.min("place").alias("place"),
        F.first("day").alias("day"),
        F.min_by("event_id", "place").alias("event_id"),
        F.min_by("event_type", "place").alias("event_type"),
        F.count(F.lit(1)).alias("events"),
        F.count(F.when(F.col("event_type") == "response", 1)).alias("replies"),
        F.count(F.when(F.col("event_type") == "tool_call", 1)).alias("tool_calls"),
        F.slice(
            F.array_distinct(
                F.transform(F.array_sort(F.collect_list(named)), lambda t: t["tool_name"])
            ), 1, 3,
        ).alias("tool_names"),
    ).select(
        F.when(F.col("events") > 1, "run").otherwise("item").alias("kind"),
        F.col("place").cast("bigint").alias("place"), "day", "event_id",
        F.when(F.col("events") == 1, F.col("event_type")).alias("event_type"),
        "events", F.lit(None).cast("bigint").alias("prompts"), "replies", "tool_calls",
        "tool_names",
    )
    # A day can come back when the page is ordered by instant and days are local: a header each.
    headers = marked.where("new_day").select("place", "day").join(
        page.withColumn("day", day).groupBy("day").agg(
            F.count(F.lit(1)).alias("events"),
            F.count(F.when(F.col("event_type") == "prompt", 1)).alias("prompts"),
        ), "day",
    ).select(
        F.lit("day").alias("kind"), F.col("place").cast("bigint").alias("place"), "day",
        F.lit(None).cast("string").alias("event_id"),
        F.lit(None).cast("string").alias("event_type"), "events", "prompts",
        F.lit(None).cast("bigint").alias("replies"),
        F.lit(None).cast("bigint").alias("tool_calls"),
        F.lit(None).cast("array<string>").alias("tool_names"),
    )
    return headers.unionByName(entries).orderBy("place", F.col("kind") != "day")
