"""Pushed event batches and the ingest audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.contract import EVENT_INPUT


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(part.capitalize() for part in rest)


WIRE_EVENT = ", ".join(
    f"{_camel(f.name)}: {f.dataType.simpleString()}" for f in EVENT_INPUT.fields
)
WIRE_SCHEMA = f"providerId string, events array<struct<{WIRE_EVENT}>>"


def _events(batches: DataFrame) -> DataFrame:
    """The events of all batches, however large.

    A batch that is empty, or that could not be read as JSON, gives one row without any event
    fields: it fails validation and so is counted as rejected. A missing provider id fails the
    events that name none themselves.
    """
    rows = batches.select(F.col("providerId").alias("batch_provider"), F.explode_outer("events").alias("e"))
    columns = [
        F.coalesce(F.col("e.providerId"), F.col("batch_provider")).alias("provider_id")
        if field.name == "provider_id"
        else F.col(f"e.{_camel(field.name)}").alias(field.name)
        for field in EVENT_INPUT.fields
    ]
    return rows.select(*columns)


def read_batches(spark: SparkSession, directory: str) -> DataFrame:
    """Source events of a landing directory of JSON batches; an event may name its own provider."""
    return _events(spark.read.schema(WIRE_SCHEMA).option("multiLine", True).json(directory))


def stream_batches(spark: SparkSession, directory: str, max_files: int = 1000) -> DataFrame:
    return _events(
        spark.readStream.schema(WIRE_SCHEMA).option("multiLine", True)
        .option("maxFilesPerTrigger", max_files).json(directory)
    )


def recent_batches(audit: DataFrame, limit: int = 20) -> DataFrame:
    """Latest ingest batches, newest first."""
    return audit.orderBy(F.desc("started_at"), F.desc("batch_id")).limit(limit)
