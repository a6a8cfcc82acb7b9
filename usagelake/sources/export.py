"""Export of the event log to JSON and CSV, its manifest, and reading an export back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.contract import EventFilters, Settings, Tables
from usagelake.functions.timeutil import iso_utc
from usagelake.operators.filters import apply_filters, prune
from usagelake.operators.maintenance import table_counts
from usagelake.session import free_shuffles

FORMAT_VERSION = 1

# Export column and the contract column behind it, in file order.
CSV_COLUMNS = (
    ("id", "event_id"), ("timestamp", "timestamp"), ("localDate", "local_date"),
    ("tzOffsetMinutes", "tz_offset_minutes"), ("eventType", "event_type"),
    ("providerId", "provider_id"), ("model", "model"), ("modelFamily", "model_family"),
    ("sessionId", "session_id"), ("projectId", "project_id"), ("projectName", "project_name"),
    ("repository", "repository"), ("gitBranch", "git_branch"),
    ("workingDirectory", "working_directory"), ("isSubagent", "is_subagent"),
    ("category", "category"), ("categoryConfidence", "category_confidence"),
    ("technologies", "technologies"), ("toolName", "tool_name"),
    ("inputTokens", "input_tokens"), ("outputTokens", "output_tokens"),
    ("cacheReadTokens", "cache_read_tokens"), ("cacheWriteTokens", "cache_write_tokens"),
    ("estimatedCostUsd", "estimated_cost_usd"), ("durationMs", "duration_ms"),
    ("charLength", "char_length"), ("redactionCount", "redaction_count"),
    ("sourceVersion", "source_version"), ("promptText", "prompt_text"),
)


def export_rows(
    tables: Tables, f: EventFilters | None = None, include_prompts: bool = True,
    settings: Settings | None = None,
) -> DataFrame:
    """Flat export frame: one row per event with its project, labels, prompt and tool.

    Without prompt text (by choice or in metadata-only mode) the column is all null and the text
    is never read.
    """
    tables = prune(tables, f)
    keep_text = include_prompts and not (settings and settings.metadata_only)
    text = F.col("text") if keep_text else F.lit(None).cast("string")
    technologies = tables.technologies.groupBy("event_id").agg(
        F.array_sort(F.collect_set("technology")).alias("technologies")
    )
    return (
        apply_filters(tables, f)
        .join(
            tables.projects.select("project_id", F.col("name").alias("project_name")),
            "project_id", "left",
        )
        .join(
            tables.classifications.select(
                "event_id", "category", F.col("confidence").alias("category_confidence")
            ), "event_id", "left",
        )
        .join(
            tables.prompts.select(
                "event_id", text.alias("prompt_text"), "char_length", "redaction_count"
            ), "event_id", "left",
        )
        .join(technologies, "event_id", "left")
        .join(tables.tool_calls.select("event_id", "tool_name"), "event_id", "left")
        .withColumn("timestamp", iso_utc(F.col("ts_ms")))
        .withColumn("technologies",
                    F.coalesce("technologies", F.array().cast("array<string>")))
        .select(*[F.col(column).alias(name) for name, column in CSV_COLUMNS])
    )


def manifest(
    tables: Tables, f: EventFilters | None, include_prompts: bool, exported_at: str,
    application: str = "usagelake",
) -> DataFrame:
    """One row describing an export: version, filters and the row count of every table."""
    frames = {name: df for name, df in vars(tables).items() if df is not None}
    counts = table_counts(frames).agg(
        F.array_sort(F.collect_list(F.struct("table", "rows"))).alias("rowCounts")
    )
    used = {k: str(v) for k, v in vars(f or EventFilters()).items() if v is not None}
    return counts.select(
        F.lit(application).alias("application"),
        F.lit(FORMAT_VERSION).alias("formatVersion"),
        F.lit(exported_at).alias("exportedAt"),
        F.lit(include_prompts).alias("includesPromptText"),
        F.lit(json.dumps(used, sort_keys=True)).alias("filters"),
        "rowCounts",
    )


def write_json(
    rows: DataFrame, described: DataFrame, path: str, compression: str | None = None
) -> None:
    """Events as JSON lines in time order beside a one-row manifest, written in parallel.

    ``compression`` is that of the event files, such as gzip; ``read_export`` reads either.
    """
    described.write.mode("overwrite").json(f"{path}/manifest")
    rows.orderBy("timestamp", "id").write.mode("overwrite").json(
        f"{path}/events", compression=compression
    )
    free_shuffles(rows.sparkSession)


def csv_rows(rows: DataFrame) -> DataFrame:
    """The export as plain CSV cells: lists comma-joined, the flag as 0 or 1, null as empty."""
    return rows.withColumn("technologies", F.nullif(F.array_join("technologies", ","), F.lit("")))\
        .withColumn("isSubagent", F.col("isSubagent").cast("int"))


def write_csv(rows: DataFrame, path: str, compression: str | None = None) -> None:
    """29 columns, quotes doubled inside quoted cells."""
    csv_rows(rows).orderBy("timestamp", "id").write.mode("overwrite").option(
        "header", True
    ).option("escape", '"').option("emptyValue", "").csv(path, compression=compression)
    free_shuffles(rows.sparkSession)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """An export as source events again; its row id becomes the external id."""
    schema = (
        "id string, timestamp string, tzOffsetMinutes int, eventType string, providerId string, "
        "model string, sessionId string, repository string, gitBranch string, "
        "workingDirectory string, isSubagent boolean, toolName string, inputTokens bigint, "
        "outputTokens bigint, cacheReadTokens bigint, cacheWriteTokens bigint, "
        "durationMs bigint, sourceVersion string, promptText string"
    )
    return spark.read.schema(schema).json(f"{path}/events").select(
        F.col("id").alias("external_id"), F.col("providerId").alias("provider_id"), "model",
        "timestamp", F.col("tzOffsetMinutes").alias("tz_offset_minutes"),
        F.col("sessionId").alias("session_id"), F.col("isSubagent").alias("is_subagent"),
        F.col("workingDirectory").alias("working_directory"), "repository",
        F.col("gitBranch").alias("git_branch"), F.col("eventType").alias("event_type"),
        F.col("promptText").alias("prompt"), F.col("toolName").alias("tool_name"),
        F.col("inputTokens").alias("input_tokens"), F.col("outputTokens").alias("output_tokens"),
        F.col("cacheReadTokens").alias("cache_read_tokens"),
        F.col("cacheWriteTokens").alias("cache_write_tokens"),
        F.col("durationMs").alias("duration_ms"), F.col("sourceVersion").alias("source_version"),
    )
