"""Idle-clamped active time.

Between consecutive events of a session the gap counts, up to the idle limit; every session-day
adds one tail allowance. A plain ``lag`` over the session would put a whole session into one task,
and one session may hold a third of the log. So the gaps are taken in two levels:

1. events collapse to distinct (session, millisecond) points with a map-side combine, since events
   at the same instant add no gap;
2. gaps are taken inside fixed ten-minute buckets of a session. A bucket holds at most 600,000
   instants whatever the number of events, so no window partition grows with the data;
3. one summary row per bucket carries the last instant forward to the next bucket. A session has
   at most 52,560 buckets a year, so this second window is bounded by calendar time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.contract import DEFAULT_IDLE_MS, TAIL_MS

BUCKET_MS = 600_000


def _clamped(gap: Column, idle_ms: int) -> Column:
    """Null stays null: ``least`` alone would turn a missing predecessor into a full idle gap."""
    return F.when(gap <= idle_ms, gap).when(gap > idle_ms, F.lit(idle_ms))


def session_days(
    events: DataFrame, idle_ms: int = DEFAULT_IDLE_MS, slice_by: Sequence[str] = ()
) -> DataFrame:
    """Clamped gap total per (slice, session, local day).

    A gap is charged to the day of its later event, so the one across midnight is kept. Events at
    the same instant under several local days charge the earliest one.
    ``slice_by`` restarts the sequence per slice: with ``project_id`` only events of the same
    project are consecutive.
    """
    slice_by = list(slice_by)
    keys = [*slice_by, "session_id"]
    points = (
        events.where(F.col("session_id").isNotNull())
        .select(*keys, F.floor(F.col("ts_ms") / F.lit(BUCKET_MS)).alias("bucket"),
                "ts_ms", "local_date")
        .distinct()
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy("ts_ms", "local_date")
    gaps = points.withColumn("prev_ms", F.lag("ts_ms").over(inside))
    per_bucket = gaps.groupBy(*keys, "bucket", "local_date").agg(
        F.sum(_clamped(F.col("ts_ms") - F.col("prev_ms"), idle_ms)).alias("inner_ms"),
        F.min(F.when(F.col("prev_ms").isNull(), F.col("ts_ms"))).alias("head_ms"),
        F.max("ts_ms").alias("last_ms"),
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    )
    carried = F.col("head_ms") - F.max("last_ms").over(earlier)
    gap = F.coalesce("inner_ms", F.lit(0)) + F.coalesce(_clamped(carried, idle_ms), F.lit(0))
    return (
        per_bucket.withColumn("gap_ms", gap)
        .groupBy(*keys, "local_date")
        .agg(F.sum("gap_ms").cast("bigint").alias("gap_ms"))
    )


def active_time(
    events: DataFrame, by: Sequence[str] = (), slice_by: Sequence[str] = (),
    idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS,
) -> DataFrame:
    """``active_ms`` per ``by`` group, with the session-days behind it.

    ``by`` may name slice columns, ``session_id`` and ``local_date``; empty gives one total row.
    """
    days = session_days(events, idle_ms, slice_by)
    return days.groupBy(*by).agg(
        (F.coalesce(F.sum("gap_ms"), F.lit(0)) + F.count(F.lit(1)) * F.lit(tail_ms))
        .cast("bigint").alias("active_ms"),
        F.count(F.lit(1)).alias("session_days"),
    )


def active_by_day(
    events: DataFrame, idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS,
    slice_by: Sequence[str] = (),
) -> DataFrame:
    """Active time and distinct sessions per local day."""
    return active_time(events, [*slice_by, "local_date"], slice_by, idle_ms, tail_ms).withColumnRenamed(
        "session_days", "sessions"
    )
