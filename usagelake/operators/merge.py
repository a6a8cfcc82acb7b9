"""Idempotent fill-only merge of normalised events into the stored log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns a later copy of an event may still fill in when the stored one has none.
FILL_COLUMNS = (
    "model", "model_family", "session_id", "project_id", "input_tokens", "output_tokens",
    "cache_read_tokens", "cache_write_tokens", "estimated_cost_usd", "duration_ms", "git_branch",
    "repository",
)


def _fold(rows: DataFrame, order: Column) -> DataFrame:
    """One row per dedupe key: the first copy, with its gaps filled from later copies.

    A copy may fill only while the surviving row's ``ingest_version`` is not above its own.
    Copies are first reduced per (key, version) with a map-side combine, so a key with any number
    of copies arrives at its reducer as one partial row per task; the second step then sees one
    row per version.
    """
    base = [c for c in rows.columns if c not in FILL_COLUMNS and c != "dedupe_key"]
    fill = [c for c in FILL_COLUMNS if c in rows.columns]
    seq = rows.withColumn("_seq", order)
    per_version = seq.groupBy("dedupe_key", F.col("ingest_version").alias("_version")).agg(
        F.min(F.struct("_seq", *[F.col(c) for c in base if not _is_map(rows, c)])).alias("_base"),
        *[
            F.min(
                F.when(F.col(c).isNotNull(), F.struct("_seq", F.col(c).alias("value")))
            ).alias(c)
            for c in fill
        ],
    )
    gathered = per_version.groupBy("dedupe_key").agg(
        F.collect_list(
            F.struct(F.col("_base._seq").alias("_first"), "_version", "_base", *fill)
        ).alias("_copies")
    )
    survivor = gathered.withColumn(
        "_row",
        F.array_min(
            F.transform(
                "_copies",
                lambda c: F.struct(
                    c["_first"].alias("_first"), c["_version"].alias("_version"),
                    c["_base"].alias("_base"),
                ),
            )
        ),
    )
    def earliest_known(name: str) -> Column:
        eligible = F.filter("_copies", lambda c: c["_version"] >= F.col("_row._version"))
        return F.array_min(F.transform(eligible, lambda c: c[name]))["value"].alias(name)

    filled = [earliest_known(name) for name in fill]
    out = survivor.select("dedupe_key", "_row._base.*", *filled)
    return out.select(*rows.columns)


def _is_map(df: DataFrame, column: str) -> bool:
    return dict(df.dtypes)[column].startswith("map")


def merge_events(
    stored: DataFrame | None, incoming: DataFrame, order: Column | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Stored log after ingesting a batch; merging the same batch again changes nothing.

    ``order`` ranks copies inside the batch (for instance file and line); by default the earliest
    instant wins and equal copies are interchangeable. Who reads only some ``columns`` names them
    (with dedupe_key and ingest_version): rows are folded as structs, which the optimizer does not
    narrow, and would be shuffled whole.
    """
    rank = order if order is not None else F.struct("ts_ms")
    batch = incoming.withColumn("_rank", F.struct(F.lit(1).alias("batch"), rank.alias("order")))
    if columns is not None:
        batch = batch.select(*columns, "_rank")
        stored = stored.select(*columns) if stored is not None else None
    if stored is None:
        return _fold(batch, F.col("_rank")).drop("_rank")
    kind = dict(batch.dtypes)["_rank"]
    first = F.struct(F.lit(0).alias("batch"), F.lit(None).alias("order")).cast(kind)
    both = stored.withColumn("_rank", first).unionByName(batch.select(*stored.columns, "_rank"))
    return _fold(both, F.col("_rank")).drop("_rank")


def merge_outcome(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Accepted and deduplicated counts of a batch, as one row."""
    keys = incoming.groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("copies"))
    if stored is None:
        known = keys.withColumn("known", F.lit(False))
    else:
        have = stored.select("dedupe_key").distinct().withColumn("known", F.lit(True))
        known = keys.join(have, "dedupe_key", "left").withColumn(
            "known", F.coalesce("known", F.lit(False))
        )
    return known.agg(
        F.count(F.when(~F.col("known"), 1)).alias("accepted"),
        (F.coalesce(F.sum("copies"), F.lit(0)) - F.count(F.when(~F.col("known"), 1))).alias(
            "deduped"
        ),
    )


def touched_days(incoming: DataFrame) -> DataFrame:
    """(day, provider) pairs whose rollups a batch may have changed, new or filled."""
    return incoming.select("local_date", "provider_id").distinct()


def union_touched(*frames: DataFrame) -> DataFrame:
    """Union of touched pairs from ingest, attribution and enrichment."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def existing_keys(events: DataFrame, keys: DataFrame) -> DataFrame:
    """Which of the given dedupe keys are already stored."""
    return keys.select("dedupe_key").distinct().join(
        events.select("dedupe_key"), "dedupe_key", "left_semi"
    )


def new_projects(batch: DataFrame) -> DataFrame:
    """Distinct projects seen in a batch."""
    return batch.where(F.col("project_id").isNotNull()).select(
        "project_id", "project_path"
    ).dropDuplicates(["project_id"])
