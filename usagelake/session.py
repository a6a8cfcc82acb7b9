"""Session defaults for jobs that start their own Spark session."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "usagelake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every operator was planned under.

    AQE sizes shuffle partitions at run time and splits skewed join partitions; the session zone
    is pinned because the drivers' timestamps carry no zone. Operators themselves derive local
    days with integer arithmetic, so a differently configured session gives the same numbers.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of writes that have ended.

    Spark drops them once the driver's JVM has collected their plans. On a large heap that can take
    half an hour, and the files of one write lie on the disks beside those of the next. Events of the
    write hold its plan until the listeners have had them, so it is asked for twice.
    """
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows only when the input has fewer splits than the cluster has cores.

    A large input arrives in more splits than that and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal(table: DataFrame, *keys: str) -> DataFrame:
    """A stored table with work ahead of it, dealt by its keys where its files leave cores idle.

    A row group is read by one task however many splits its file is cut into, so splits say little.
    The rows of each are counted from the footers, without reading a column; a table whose largest
    split holds no more than a core's share passes through without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    split = table.groupBy(F.spark_partition_id().alias("split")).agg(F.count(F.lit(1)).alias("rows"))
    most, total = split.agg(F.max("rows"), F.sum("rows")).first()
    if not total or most * cores <= total:
        return table
    return table.repartition(max(cores, table.rdd.getNumPartitions()), *keys)
