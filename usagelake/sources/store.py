"""The event log on disk: Parquet datasets partitioned by local day and provider."""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.contract import Tables
from usagelake.sources.append_log import LOGGED, OPEN, AppendLog
from usagelake.sources.key_index import KeyIndex

PARTITIONED = ("log", "annotations", "events", "prompts", "responses", "tool_calls", "classifications", "technologies",
               "contexts", "terms")
#: Order inside the files of a set, for ranges that a scan may skip.
SORTED = {"terms": ("token", "event_id")}
ROLLUPS = ("daily_rollups", "daily_active")
#: Sets without partitions, written as versions.
SWAPPED = ("projects", "providers", *OPEN)

_KEYS = "event_id string, local_date date, provider_id string"
#: Side tables a young store may not hold yet.
SIDE_SCHEMAS = {
    "prompts": f"{_KEYS}, text string, text_hash string, normalized_hash string, char_length int, "
               "word_length int, redaction_count int, preview string",
    "responses": f"{_KEYS}, text string, char_length int, redaction_count int",
    "tool_calls": f"{_KEYS}, session_id string, tool_name string, succeeded boolean, "
                  "duration_ms bigint, target_extension string",
    "classifications": f"{_KEYS}, category string, confidence double, source string, "
                       "classifier_version int",
    "technologies": f"{_KEYS}, technology string, confidence double, source string",
    "contexts": f"{_KEYS}, context string, confidence double",
}


class EventStore:
    """Named datasets under one root folder that all executors reach.

    Time-bounded questions prune partitions of the events and of every side table. Rewrites use
    dynamic partition overwrite, so only the (day, provider) folders present in the output change;
    ``replace`` also removes those that are left without rows.
    """

    def __init__(self, spark: SparkSession, root: str, by_provider: bool = True):
        """``by_provider`` adds the provider to the folders; leave it out for a small log."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.by_provider = by_provider
        self.log = AppendLog(self)
        self.keys_index = KeyIndex(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keys(self, name: str) -> tuple[str, ...]:
        tail = ("provider_id",) if self.by_provider else ()
        if name in PARTITIONED:
            return ("local_date", *tail)
        return ("day", *tail) if name in ROLLUPS else ()

    # -- files --------------------------------------------------------------------------------

    def _path(self, where: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(where)

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def finished(self, where: str) -> bool:
        """Whether a write to the path ran to its end, on whatever file system it lies."""
        marker = self._path(f"{where}/_SUCCESS")
        return self._files(marker).exists(marker)

    def remove(self, where: str) -> None:
        path = self._path(where)
        self._files(path).delete(path, True)

    def exists(self, where: str) -> bool:
        path = self._path(where)
        return self._files(path).exists(path)

    def names(self, where: str) -> list[str]:
        """Names of the files and folders below a folder, in order; none if it isn't there."""
        path = self._path(where)
        files = self._files(path)
        if not files.exists(path):
            return []
        found = (s.getPath().getName() for s in files.listStatus(path))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read_text(self, where: str) -> str:
        path = self._path(where)
        stream = self._files(path).open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, where: str, text: str) -> None:
        """A small file that is there as a whole or not at all: written beside and renamed."""
        path, beside = self._path(where), self._path(f"{where.rpartition('/')[0]}/.{uuid.uuid4().hex}")
        files = self._files(path)
        stream = files.create(beside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        files.delete(path, False)
        files.rename(beside, path)

    def _versions(self, name: str) -> list[str]:
        """Finished versions of an unpartitioned set, oldest first."""
        base = self._path(self.path(name))
        files = self._files(base)
        if not files.exists(base):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(base) if s.isDirectory())
        return [n for n in names if self.finished(f"{self.path(name)}/{n}")]

    # -- datasets -----------------------------------------------------------------------------

    def read(self, name: str) -> DataFrame | None:
        """The dataset with all published batches, or ``None`` when nothing was written to it yet."""
        return self.log.read(name) if name in LOGGED else self.stored(name)

    def stored(self, name: str) -> DataFrame | None:
        """The dataset without the batches that lie beside it."""
        where = self.path(name)
        if name in SWAPPED:
            versions = self._versions(name)
            return self.spark.read.parquet(f"{where}/{versions[-1]}") if versions else None
        try:
            # Rollups of an earlier version have fewer columns.
            return self.spark.read.option("mergeSchema", name in ROLLUPS).parquet(where)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the dataset, or for partitioned ones the partitions that occur in ``df``.

        Rows are rebalanced on the partition keys: small days share a file and a day that holds
        a large part of the data is split over several tasks. An unpartitioned set is written as a
        new version beside the old one, which readers see until the new one is finished; so it may
        be derived from what it replaces.
        """
        if name in SWAPPED:
            versions = self._versions(name)
            number = int(versions[-1].split("-")[0]) + 1 if versions else 0
            df.write.parquet(f"{self.path(name)}/{number:012d}-{uuid.uuid4().hex}")
            for old in versions[:-1]:
                self.remove(f"{self.path(name)}/{old}")
            return
        keys = self.keys(name)
        writer = self.arranged(name, df.hint("rebalance", *keys) if keys else df).write
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy(*keys) if keys else writer).parquet(self.path(name))

    def arranged(self, name: str, df: DataFrame, folders: bool = True) -> DataFrame:
        """Rows in the order in which the files of the set keep them, first by what names folders."""
        if name not in SORTED:
            return df
        return df.sortWithinPartitions(*(self.keys(name) if folders else ()), *SORTED[name])

    def replace(self, name: str, df: DataFrame, touched: DataFrame | None = None) -> None:
        """Make ``df`` all that the touched partitions hold; a partition without rows is removed.

        ``df`` must be staged, as what it was derived from is overwritten. ``touched`` has
        local_date and provider_id; without it every partition counts as touched. The list of
        emptied folders, a few per day at most, is all that reaches the driver.
        """
        stored = self.read(name)
        if stored is not None and name not in SWAPPED:
            keys = list(self.keys(name))
            folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1)
            there = stored.select(*keys, folder.alias("folder")).distinct()
            if touched is not None:
                renamed = touched.withColumnRenamed("local_date", keys[0]).select(*keys).distinct()
                there = there.join(renamed, keys, "left_semi")
            emptied = there.join(df.select(*keys).distinct(), keys, "left_anti")
            for row in emptied.select("folder").collect():
                path = self._path(self.spark._jvm.java.net.URI(row["folder"]))
                self._files(path).delete(path, True)
        self.write(name, df)

    def stage(self, batch_id: str, name: str, df: DataFrame) -> DataFrame:
        """Write a frame to the batch's staging folder and read it back.

        Cuts the lineage and survives lost executors. A staged frame of a batch that is run again
        is reused, so the retry applies exactly what the first attempt computed; one that was
        left unfinished is written again. The label must tell batches of different content apart.
        """
        path = f"{self.root}/_staging/{batch_id}/{name}"
        if not self.finished(path):
            df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def unstage(self, batch_id: str) -> None:
        """Drop what was staged for a batch that is published."""
        self.remove(f"{self.root}/_staging/{batch_id}")

    def tables(self) -> Tables:
        """Everything stored; a side table nothing was written to yet is empty."""
        found = {f.name: self.read(f.name) for f in fields(Tables)}
        for name, schema in SIDE_SCHEMAS.items():
            if found[name] is None:
                found[name] = self.spark.createDataFrame([], schema)
        return Tables(**found)

    def write_tables(self, tables: Tables) -> None:
        """Make the given tables all that is stored; they may be derived from the stored ones."""
        self.log.compact()
        label = f"tables-{uuid.uuid4().hex}"
        staged = {
            f.name: self.stage(label, f.name, getattr(tables, f.name))
            for f in fields(Tables) if getattr(tables, f.name) is not None
        }
        for name, df in staged.items():
            self.replace(name, df)
        self.unstage(label)
