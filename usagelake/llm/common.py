"""Helpers shared by the operators: shared storage, row order, running totals, skew-safe lookups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the operators that compare free text: everything but the six ASCII white-space signs.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a folder of this machine only where none is configured."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        path = tempfile.mkdtemp(prefix="usagelake-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stage(df: DataFrame, **options) -> DataFrame:
    """Write a frame to the shared folder and read it back. ``options`` go to the Parquet writer.

    It cuts the lineage, so a lost executor costs a re-read and not a recomputation, and columns
    that a later step does not need are not read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/usagelake-llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the machine, where its C library can; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def hash_bits(*cols: Column, bits: int = 62) -> Column:
    """A non-negative hash of the columns with so many bits; nulls count as values of their own."""
    parts = [p for c in cols for p in (c.isNull(), c)]
    return F.shiftrightunsigned(F.xxhash64(*parts), 64 - bits)


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running_total(
    df: DataFrame, by: list[str], order: str, value: str, out: str, bits: int = 7
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same ``by`` that come earlier.

    ``order`` is a non-negative 62-bit hash, so its leading bits deal each key's rows evenly over
    4 ** ``bits`` ranges, whatever share of the table the key holds. Only the ranges' sums are
    added up across the key, in two steps of 2 ** ``bits`` rows; the rows themselves are ordered
    inside their range. Raise ``bits`` where a range would hold more rows than a task can sort.
    ``by`` must not be null.
    """
    high, low = "_high", "_low"
    rows = df.withColumn(high, F.shiftright(order, 62 - bits)).withColumn(
        low, F.shiftright(order, 62 - 2 * bits)
    )
    ranges = rows.groupBy(*by, high, low).agg(F.sum(value).alias("_sum"))

    def earlier(column, keys, sort):
        return F.coalesce(
            F.sum(column).over(
                Window.partitionBy(*keys).orderBy(sort).rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        )

    coarse = (
        rows.groupBy(*by, high).agg(F.sum(value).alias("_sum"))
        .select(*by, high, earlier("_sum", by, high).alias("_start"))
    )
    starts = (
        ranges.withColumn("_inner", earlier("_sum", [*by, high], low)).drop("_sum")
        .join(coarse, [*by, high])
        .select(*by, high, low, (F.col("_start") + F.col("_inner")).alias("_start"))
    )
    ties = [c for c in df.columns if c not in (*by, order)]
    inner = Window.partitionBy(*by, high, low).orderBy(order, *ties).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        rows.join(starts, [*by, high, low])
        .withColumn(out, F.col("_start") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
        .drop(high, low, "_start")
    )


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is to be merged with the other: neither is sent to the driver and broadcast.

    Spark takes a frame that a Python function or an explode makes for as small as what it is made of, and
    a dictionary-coded file for as small as it is on disk. Use it where a side grows with the corpus.
    """
    return df.hint("merge")


def lookup(rows: DataFrame, table: DataFrame, on: str, spread: str, salts: int = 64) -> DataFrame:
    """Inner join of many ``rows`` with one ``table`` row per key, where one key may be very common.

    Rows of a key are dealt over ``salts`` parts by a hash of the column ``spread``; the table row
    is copied only to the parts that occur. Every exchange therefore moves at most ``salts`` rows
    of the table per key, and no task gets a common key whole. ``on`` must not be null. Both joins
    merge, as either side may grow with the corpus.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    parts = salted.select(on, "_salt").distinct().join(merged(table), on)
    return salted.join(merged(parts), [on, "_salt"]).drop("_salt")


def keep_rows(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str, once: bool = False) -> DataFrame:
    """The rows of ``docs`` whose id and text are those of a row of ``chosen`` (doc_id, body_hash).

    Rows that repeat both all stay, or any of them if only ``once``. All columns are kept; the texts are shuffled once.
    """
    one, two = "_keep_key", "_keep_text"
    key = F.xxhash64(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"))
    wanted = chosen.select(
        F.xxhash64(F.col("doc_id").isNull(), "doc_id").alias(one), F.col("body_hash").alias(two)
    ).distinct()
    marked = docs.withColumn(one, key).withColumn(two, F.xxhash64(F.col(f"`{text}`")))
    kept = marked.join(wanted, [one, two], "left_semi")
    return (kept.dropDuplicates([one, two]) if once else kept).drop(one, two)
