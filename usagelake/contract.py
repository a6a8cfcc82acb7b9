"""Event contract: domains, schemas, settings and the filter set every question accepts."""

from __future__ import annotations

import datetime as dt
import hashlib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The closed domains of the event contract.
EVENT_TYPES = (
    "prompt", "response", "tool_call", "session_start",
    "session_end", "compaction", "error", "notification",
)
PROMPT_CATEGORIES = (
    "Implementation", "Debugging", "Code Review", "Refactoring", "Explanation", "Research",
    "Planning", "Documentation", "Testing", "DevOps", "Architecture", "Writing", "Other",
)
TASK_CONTEXTS = (
    "Backend", "Frontend", "Smart Contract", "Infrastructure",
    "Testing", "Architecture", "Documentation", "Research",
)
RANGE_PRESETS = ("today", "7d", "30d", "3m", "all", "custom")

# Versions and active-time constants.
INGEST_VERSION = 1
ENRICHMENT_VERSION = 1
CLASSIFIER_VERSION = 1
DEFAULT_IDLE_MS = 5 * 60 * 1000
TAIL_MS = 60 * 1000
TOOL_LOOKAHEAD_MS = 5 * 60 * 1000

#: What a source hands over: one row per event, before validation.
EVENT_INPUT = T.StructType(
    [
        T.StructField("external_id", T.StringType()),
        T.StructField("provider_id", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("tz_offset_minutes", T.IntegerType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("parent_event_id", T.StringType()),
        T.StructField("is_subagent", T.BooleanType()),
        T.StructField("working_directory", T.StringType()),
        T.StructField("repository", T.StringType()),
        T.StructField("git_branch", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_succeeded", T.BooleanType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("cache_read_tokens", T.LongType()),
        T.StructField("cache_write_tokens", T.LongType()),
        T.StructField("cache_write_1h_tokens", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("source_version", T.StringType()),
        T.StructField("metadata", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Settings:
    """User settings. ``as_of`` stands in for "now" so every answer is reproducible."""

    timezone: str = "UTC"
    idle_ms: int = DEFAULT_IDLE_MS
    tail_ms: int = TAIL_MS
    redact_secrets: bool = True
    metadata_only: bool = False
    store_responses: bool = False
    scan_manifests: bool = False
    retention_months: int = 0
    as_of: dt.datetime = field(
        default_factory=lambda: dt.datetime.now(dt.timezone.utc).replace(microsecond=0)
    )

    def rollup_fingerprint(self) -> str:
        """Stands for everything but the log that rollups depend on."""
        parts = (self.idle_ms, self.tail_ms, ENRICHMENT_VERSION, CLASSIFIER_VERSION)
        return hashlib.sha256(repr(parts).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class EventFilters:
    """Narrowing of the event log. Day bounds replace the instant bounds when present."""

    from_ts: dt.datetime | None = None
    to_ts: dt.datetime | None = None
    from_day: str | None = None
    to_day: str | None = None
    provider_id: str | None = None
    project_id: str | None = None
    model: str | None = None
    category: str | None = None
    technology: str | None = None
    event_type: str | None = None
    session_id: str | None = None
    include_subagents: bool | None = None

    def but(self, **changes) -> "EventFilters":
        return replace(self, **changes)


@dataclass(frozen=True)
class Tables:
    """The event log with its side tables and dimensions, all lazily planned."""

    events: DataFrame
    prompts: DataFrame | None = None
    responses: DataFrame | None = None
    tool_calls: DataFrame | None = None
    classifications: DataFrame | None = None
    technologies: DataFrame | None = None
    contexts: DataFrame | None = None
    projects: DataFrame | None = None
    providers: DataFrame | None = None

    def but(self, **changes) -> "Tables":
        return replace(self, **changes)
