"""Technologies a project's package manifests reveal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions.ids import project_key
from usagelake.rules.technology import MANIFEST_FILES, MANIFEST_SIGNALS


def read_manifests(spark: SparkSession, directory: str) -> DataFrame:
    """All manifest files under a directory."""
    names = "{" + ",".join(MANIFEST_FILES) + "}"
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", names)
        .text(directory, wholetext=True)
    )
    path = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")),
                            r"^file:/+", "/")
    return files.select(
        F.regexp_extract(path, r"^(.*)/[^/]+\z", 1).alias("project_path"),
        F.regexp_extract(path, r"([^/]+)\z", 1).alias("file_name"),
        F.col("value").alias("content"),
    )


def technologies_from_manifest(content: Column) -> Column:
    """Technologies whose signal occurs in a manifest, in rule order."""
    return F.filter(
        F.array(*[F.when(content.rlike(pattern), F.lit(name)) for name, pattern in MANIFEST_SIGNALS]),
        lambda name: name.isNotNull(),
    )


def project_profiles(manifests: DataFrame) -> DataFrame:
    """Technology profile per project: the union over its manifests."""
    found = manifests.select(
        "project_path", F.explode(technologies_from_manifest(F.col("content"))).alias("technology")
    )
    return found.groupBy("project_path").agg(
        F.array_sort(F.collect_set("technology")).alias("technologies")
    ).withColumn("project_id", project_key(F.col("project_path")))
