"""Live views over the event stream: bursts of activity, hourly counts, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from usagelake.contract import DEFAULT_IDLE_MS, TAIL_MS


def deduplicated(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop repeats close in time before they reach the merge; the merge catches the rest."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["dedupe_key"])


def bursts(events: DataFrame, idle_ms: int = DEFAULT_IDLE_MS,
           watermark: str = "1 day") -> DataFrame:
    """Stretches of a session without an idle gap, as native session windows.

    Works on a stream and on a batch. ``days`` are the local days of a burst; a burst is bounded
    by its idle gap, so the set stays as small as the calendar.
    """
    source = events.where(F.col("session_id").isNotNull())
    if events.isStreaming:
        source = source.withWatermark("ts", watermark)
    return source.groupBy(
        F.session_window("ts", f"{idle_ms} milliseconds").alias("burst"), "session_id"
    ).agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"),
        F.count(F.lit(1)).alias("events"), F.collect_set("local_date").alias("days"),
    ).drop("burst")


def active_from_bursts(rows: DataFrame, idle_ms: int = DEFAULT_IDLE_MS,
                       tail_ms: int = TAIL_MS) -> DataFrame:
    """Active time per session: burst lengths, a full idle limit between bursts, day tails."""
    length = F.sum(F.col("last_ms") - F.col("first_ms")) + (F.count(F.lit(1)) - 1) * idle_ms
    # Distinct days, not bursts, are gathered: as many values as the calendar has.
    days = F.size(F.array_distinct(F.flatten(F.collect_set("days"))))
    return rows.groupBy("session_id").agg((length + days * tail_ms).alias("active_ms"))


def hourly_counts(stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Events per provider, kind and hour; an hour is emitted once it can no longer change."""
    return (
        stream.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 hour").alias("hour"), "provider_id", "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.unix_millis("hour.start").alias("hour_ms"), "provider_id", "event_type",
                "events")
    )


def observed(parsed: DataFrame, name: str = "transcripts") -> DataFrame:
    """Parsed transcript lines that report records and parse errors with every micro-batch."""
    return parsed.observe(
        name, F.count("record").alias("records"),
        F.count(F.when(F.col("record").isNull(), 1)).alias("parse_errors"),
    )


class ProgressLog(StreamingQueryListener):
    """Collects rows read and observed metrics per micro-batch."""

    def __init__(self):
        self.batches: list[dict] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        self.batches.append({
            "batch_id": progress.batchId,
            "input_rows": progress.numInputRows,
            "metrics": {k: v.asDict() for k, v in (progress.observedMetrics or {}).items()},
        })

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
