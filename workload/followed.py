"""``conversations`` as transcript files that come in three times, followed into a store."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from usagelake.contract import Settings
from usagelake.sources.store import EventStore
from usagelake.streaming import ingest as ig
from workload import transcripts as wt, views

_FOLLOWED: set[str] = set()


def ingest(spark: SparkSession, sf_dir: str) -> ig.Ingest:
    """Prompts, replies and calls come first, compactions second; then the batches are compacted,
    and the answers to the calls come last."""
    root = f"{views.root(spark, sf_dir)}-followed"
    out = ig.Ingest(EventStore(spark, f"{root}/store"), Settings(timezone="UTC"), defer_rollups=True)
    if root in _FOLLOWED:
        return out
    lines = wt.lines(spark, sf_dir).select("value")
    result, system = F.col("value").contains('"tool_result"'), F.col("value").startswith('{"type":"system"')
    for n, part in enumerate((~result & ~system, system, result)):
        lines.where(part).write.mode("overwrite").text(f"{root}/files/part={n}")
        stream = ig.transcripts(spark, f"{root}/files", wt.PATTERN)
        query = ig.backfill(stream, out, f"{root}/checkpoint", lines=True)
        query.awaitTermination()
        if n == 1:
            out.compact()
    _FOLLOWED.add(root)
    return out
