"""Which dedupe keys are stored, without reading the events.

Keys lie in generations, each written once: the keys by the first digits of their hash, and a Bloom
field sized to them. A batch asks the fields first; only keys that a field may hold, and only the
buckets of these, are read and compared. A batch of new keys so reads the fields, some three bytes
a stored key, and about one key in two thousand goes on to a bucket.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the field a key, positions a key sets, and bits in one row of the field.
PER_KEY, POSITIONS, WORD = 24, 4, 48
LEAST_BITS = 1 << 12
#: Leading hexadecimal digits of a key that name its bucket.
DIGITS = 2
#: Generations that are asked one by one before they are written as one.
MOST_GENERATIONS = 8


def _positions(bits: int) -> Column:
    """Places of a key in a field, cut from its SHA-256 in hexadecimal."""
    return F.array(*[
        F.pmod(F.conv(F.substring("dedupe_key", 1 + 12 * k, 12), 16, 10).cast("long"), F.lit(bits))
        for k in range(POSITIONS)])


class KeyIndex:
    """The dedupe keys of an ``EventStore``, each with the day and provider of its event."""

    def __init__(self, store):
        self.store = store
        self.spark = store.spark
        self.root = f"{store.root}/_keys"

    def generations(self) -> dict[str, dict]:
        """Finished generations that no later one replaces: label to bits and number of keys."""
        found = {n: json.loads(self.store.read_text(f"{self.root}/finished/{n}"))
                 for n in self.store.names(f"{self.root}/finished")}
        replaced = {old for g in found.values() for old in g["replaces"]}
        return {n: g for n, g in found.items() if n not in replaced}

    def add(self, label: str, keys: DataFrame, replaces: list[str] | None = None) -> None:
        """Write a generation: ``dedupe_key``, ``local_date``, ``provider_id``; once per label."""
        done = f"{self.root}/finished/{label}"
        if self.store.exists(done):
            return
        where = f"{self.root}/generations/{label}"
        bucketed = keys.select("dedupe_key", "local_date", "provider_id").dropDuplicates(["dedupe_key"]).withColumn(
            "bucket", F.substring("dedupe_key", 1, DIGITS))
        writer = bucketed.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("bucket").parquet(f"{where}/keys")
        n = self._keys(label).count()
        bits = max(LEAST_BITS, 1 << (n * PER_KEY - 1).bit_length() if n else 0)
        at = self._keys(label).select(F.explode(_positions(bits)).alias("at"))
        field = at.groupBy(F.expr(f"at div {WORD}").alias("word")).agg(
            F.expr(f"bit_or(shiftleft(1L, cast(at % {WORD} as int)))").alias("bits"))
        field.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{where}/field")
        self.store.write_text(done, json.dumps({"bits": bits, "n": n, "replaces": replaces or []}))
        for old in replaces or []:
            self.store.remove(f"{self.root}/generations/{old}")
        standing = self.generations()
        if len(standing) > MOST_GENERATIONS:
            self._fold(label, standing)

    def _fold(self, label: str, standing: dict[str, dict]) -> None:
        rows = None
        for name in standing:
            part = self._keys(name)
            rows = part if rows is None else rows.unionByName(part)
        self.add(f"all-{label}", rows, list(standing))

    def rebuild(self, label: str, keys: DataFrame | None) -> None:
        """Make the given keys all that is stored, after events were deleted."""
        standing = list(self.generations())
        if keys is not None:
            self.add(label, keys, standing)
        else:
            self.store.remove(self.root)

    def _keys(self, label: str, buckets: list[str] | None = None) -> DataFrame:
        df = self.spark.read.schema(
            "dedupe_key string, local_date date, provider_id string, bucket string"
        ).parquet(f"{self.root}/generations/{label}/keys")
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def maybe(self, label: str, bits: int, keys: DataFrame) -> DataFrame:
        """Keys all of whose places are set in the field of a generation."""
        field = self.spark.read.schema("word long, bits long").parquet(f"{self.root}/generations/{label}/field")
        asked = keys.select("dedupe_key", F.explode(_positions(bits)).alias("at"))
        hits = asked.join(field, F.expr(f"at div {WORD}") == F.col("word")).where(
            F.expr(f"shiftright(bits, cast(at % {WORD} as int)) & 1L = 1L"))
        return hits.groupBy("dedupe_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= POSITIONS).select(
            "dedupe_key")

    def known(self, label: str, keys: DataFrame) -> DataFrame:
        """Staged under ``label``: which of the distinct ``keys`` are stored, with day and provider.

        The buckets of keys that pass a field, 256 at most, are named to the scan.
        """
        found = self.store.log.part("keys")
        if found is not None:
            found = found.drop("_batch").join(keys.select("dedupe_key"), "dedupe_key", "left_semi")
        for name, generation in self.generations().items():
            maybe = self.store.stage(label, f"maybe-{name}", self.maybe(name, generation["bits"], keys))
            bucket = F.substring("dedupe_key", 1, DIGITS)
            buckets = [r[0] for r in maybe.select(bucket).distinct().collect()]
            if buckets:
                part = self._keys(name, buckets).drop("bucket").join(maybe, "dedupe_key", "left_semi")
                found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.spark.createDataFrame([], "dedupe_key string, local_date date, provider_id string")
        return self.store.stage(label, "known", found.dropDuplicates(["dedupe_key"]))
