"""Time-directed lookups inside a session, planned so that one huge session cannot stall a task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.contract import TOOL_LOOKAHEAD_MS
from usagelake.functions.ids import is_real_model

BUCKET_MS = 600_000


def first_following(
    events: DataFrame, keys: Sequence[str], is_probe: Column, is_fact: Column,
    payload: Sequence[str], inclusive: bool,
) -> DataFrame:
    """For every (keys, instant) at which a probe sits, the earliest fact at or after it.

    Events collapse to one point per (keys, millisecond) before anything is ordered. Inside a
    ten-minute bucket a descending window finds the next fact; when the bucket has none left, the
    first fact of a later bucket is carried back over a one-row-per-bucket summary. Descending
    order with an unbounded-preceding frame is a running value; the mirrored ascending frame is
    re-evaluated for every row.

    The result has one row per probed instant that found a fact: ``keys, ts_ms, found`` where
    ``found`` is ``struct(fact_ms, event_id, *payload)``. Equal instants go to the lowest id.
    """
    keys = list(keys)
    fact = F.struct(
        F.col("ts_ms").alias("fact_ms"), F.col("event_id").alias("fact_id"),
        *[F.col(c).alias(c) for c in payload],
    )
    # The keys are filtered here so that both readers below share one shuffle of the points.
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "bucket"]])
    points = (
        events.where(is_probe | is_fact)
        .withColumn("bucket", F.floor(F.col("ts_ms") / F.lit(BUCKET_MS)))
        .where(present)
        .groupBy(*keys, "bucket", "ts_ms")
        .agg(F.min(F.when(is_fact, fact)).alias("fact"), F.max(is_probe).alias("probed"))
    )
    later = Window.partitionBy(*keys, "bucket").orderBy(F.col("ts_ms").desc())
    here = later.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    within = points.withColumn("inner", F.last("fact", ignorenulls=True).over(here))
    per_bucket = points.groupBy(*keys, "bucket").agg(
        F.min("fact").alias("first_fact"), F.max("probed").alias("any_probe")
    )
    beyond = (
        Window.partitionBy(*keys).orderBy(F.col("bucket").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        per_bucket.withColumn("carried", F.last("first_fact", ignorenulls=True).over(beyond))
        .where(F.col("any_probe"))
        .select(*keys, "bucket", "carried")
    )
    joined = within.where(F.col("probed")).join(carry, [*keys, "bucket"], "left")
    return joined.select(
        *keys, "ts_ms", F.coalesce("inner", "carried").alias("found")
    ).where(F.col("found").isNotNull())


def prompt_models(events: DataFrame) -> DataFrame:
    """Model that answered each unattributed prompt instant.

    The first reply at or after the prompt in the same session, on the same side of a sub-agent
    boundary, whose model is a real one.
    """
    in_session = F.col("session_id").isNotNull()
    probe = in_session & (F.col("event_type") == "prompt") & F.col("model").isNull()
    fact = in_session & (F.col("event_type") == "response") & F.coalesce(
        is_real_model(F.col("model")), F.lit(False)
    )
    found = first_following(
        events, ["session_id", "is_subagent"], probe, fact, ["model", "model_family"], True
    )
    return found.select(
        "session_id", "is_subagent", "ts_ms",
        F.col("found.model").alias("linked_model"),
        F.col("found.model_family").alias("linked_family"),
    )


def link_prompt_models(events: DataFrame) -> DataFrame:
    """Events with unattributed prompts filled in, and ``linked`` telling which ones changed.

    Running it again changes nothing; an unanswered prompt keeps its null.
    """
    links = prompt_models(events).withColumn("in_session", F.lit(True))
    # Sessionless events get a key of their own so that they spread instead of meeting in one task.
    keyed = events.withColumn("in_session", F.col("session_id").isNotNull()).withColumn(
        "link_session", F.coalesce("session_id", "event_id")
    )
    wants = (F.col("event_type") == "prompt") & F.col("model").isNull()
    joined = keyed.join(
        links.withColumnRenamed("session_id", "link_session"),
        ["link_session", "in_session", "is_subagent", "ts_ms"], "left",
    )
    linked = wants & F.col("linked_model").isNotNull()
    return (
        joined.withColumn("linked", F.coalesce(linked, F.lit(False)))
        .withColumn("model_family", F.when(F.col("linked"), F.col("linked_family"))
                    .otherwise(F.col("model_family")))
        .withColumn("model", F.when(F.col("linked"), F.col("linked_model"))
                    .otherwise(F.col("model")))
        .select(*events.columns, "linked")
    )


def changed_days(linked: DataFrame) -> DataFrame:
    """(day, provider) pairs whose rollups an attribution pass made stale."""
    return linked.where("linked").select("local_date", "provider_id").distinct()


def next_responses(events: DataFrame, responses: DataFrame) -> DataFrame:
    """First recorded response strictly after each prompt of a session, with its text."""
    with_text = events.join(
        responses.select("event_id", F.lit(True).alias("has_response")), "event_id", "left"
    )
    in_session = F.col("session_id").isNotNull()
    found = first_following(
        with_text, ["session_id"], in_session & (F.col("event_type") == "prompt"),
        in_session & F.coalesce("has_response", F.lit(False)), [], False,
    ).select("session_id", "ts_ms", F.col("found.fact_id").alias("response_event_id"))
    prompts = events.where(in_session & (F.col("event_type") == "prompt")).select(
        "event_id", "session_id", "ts_ms"
    )
    texts = responses.select(
        F.col("event_id").alias("response_event_id"), F.col("text").alias("response_text")
    )
    return (
        prompts.join(found, ["session_id", "ts_ms"], "left")
        .join(texts, "response_event_id", "left")
        .select("event_id", "session_id", "response_event_id", "response_text")
    )


def following_tools(events: DataFrame, tool_calls: DataFrame,
                    window_ms: int = TOOL_LOOKAHEAD_MS) -> DataFrame:
    """Distinct tools that ran within the window after each prompt of a session.

    With buckets as long as the window, a tool ran in ``(t, t + window]`` exactly when its last
    run in the prompt's bucket is after ``t`` or its first run in the next bucket is not after
    ``t + window``. So per (session, bucket, tool) two instants are enough, and no prompt is ever
    paired with individual tool runs.
    """
    calls = (F.col("event_type") == "tool_call") & F.col("session_id").isNotNull()
    runs = (
        events.where(calls)
        .join(tool_calls.select("event_id", "tool_name"), "event_id")
        .groupBy(
            "session_id", F.floor(F.col("ts_ms") / F.lit(window_ms)).alias("bucket"), "tool_name"
        )
        .agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    )
    nothing = F.lit(None).cast("bigint")
    probes = runs.select(
        "session_id", "tool_name",
        F.explode(
            F.array(
                F.struct(F.col("bucket").alias("bucket"), F.col("last_ms").alias("same_last"),
                         nothing.alias("next_first")),
                F.struct((F.col("bucket") - 1).alias("bucket"), nothing.alias("same_last"),
                         F.col("first_ms").alias("next_first")),
            )
        ).alias("slot"),
    ).select("session_id", "tool_name", "slot.*")
    per_tool = probes.groupBy("session_id", "bucket", "tool_name").agg(
        F.max("same_last").alias("same_last"), F.min("next_first").alias("next_first")
    )
    # One entry per distinct tool name: bounded by the tool catalogue, not by the calls.
    catalogue = per_tool.groupBy("session_id", "bucket").agg(
        F.collect_list(F.struct("tool_name", "same_last", "next_first")).alias("tools")
    )
    prompts = events.where(
        (F.col("event_type") == "prompt") & F.col("session_id").isNotNull()
    ).select(
        "event_id", "session_id", "ts_ms",
        F.floor(F.col("ts_ms") / F.lit(window_ms)).alias("bucket"),
    )
    seen = F.filter(
        "tools",
        lambda t: F.coalesce(t["same_last"] > F.col("ts_ms"), F.lit(False))
        | F.coalesce(t["next_first"] <= F.col("ts_ms") + F.lit(window_ms), F.lit(False)),
    )
    return prompts.join(catalogue, ["session_id", "bucket"], "left").select(
        "event_id",
        F.array_sort(
            F.coalesce(
                F.transform(seen, lambda t: t["tool_name"]), F.array().cast("array<string>")
            )
        ).alias("tool_names"),
    )
