"""Exact dedup: a two-pass Bloom filter lets documents that occur once bypass the shuffle.

Pass one sets, for every text, ``HASHES`` positions of a bit field and notes the positions that
were set twice. Pass two asks for each text whether all its positions were set twice: if not, no
other document has the text and its row is final as it stands. Only the rest, the repeated texts
and a few false positives, is shuffled and grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, read, stage
from .registry import query

#: Positions per text.
HASHES = 2
#: The field has 2 ** bits positions: about 16 for each text, but never more than 2 ** 24. One
#: word of 48 positions is a row of the broadcast, so that is 350,000 rows or 14 MB at most;
#: beyond 2 ** 20 texts the filter lets more unique rows through to the shuffle, and the result
#: is the same.
LEAST_BITS, MOST_BITS, PER_TEXT = 12, 24, 16
WORD = 48


def _position(digest: Column, k: int, bits: int) -> Column:
    """The k-th position of a text, cut from its SHA-256 digest in hexadecimal."""
    part = F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("long")
    return F.pmod(part, F.lit(1 << bits))


def _set_twice(digests: DataFrame, bits: int) -> DataFrame:
    """Words of the bit field whose bits are the positions that more than one insertion set.

    Counts are combined before the exchange, so a text held by a third of all rows sends one row
    per task.
    """
    return (
        digests.select(
            F.explode(F.array(*[_position(F.col("sha"), k, bits) for k in range(HASHES)])).alias("at")
        )
        .groupBy("at").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .groupBy(F.expr(f"at div {WORD}").alias("word"))
        .agg(F.expr(f"bit_or(shiftleft(1L, cast(at % {WORD} as int)))").alias("bits"))
    )


def _probe(digests: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Add ``maybe``: whether every position of the text was set twice."""
    out = digests.withColumn("maybe", F.lit(True))
    for k in range(HASHES):
        out = out.withColumn("_at", _position(F.col("sha"), k, bits))
        field = F.broadcast(words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
        hit = F.expr(f"coalesce(shiftright(_bits, cast(_at % {WORD} as int)) & 1L, 0L) = 1L")
        out = (
            out.join(field, F.expr(f"_at div {WORD}") == F.col("_word"), "left")
            .withColumn("maybe", F.col("maybe") & hit).drop("_at", "_word", "_bits")
        )
    return out


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; of equal texts the row with the largest id stays.
    A null text counts as empty. A null id is smaller than any other. Rows that repeat both id and
    text count one by one in ``group_size``; each carries ``kept`` of its id. An empty table gives
    an empty result; other columns are not looked at.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    digests = stage(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.sha2(F.encode(body, "UTF-8"), 256).alias("sha")
    ))
    n = digests.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (n * PER_TEXT - 1).bit_length() if n else 0))
    probed = _probe(digests, _set_twice(digests, bits), bits)
    alone = probed.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"
    )
    shared = probed.where("maybe").drop("maybe")
    groups = shared.groupBy("sha").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    grouped = lookup(shared, groups, "sha", "doc_id").select("doc_id", "keep_id", "group_size", "sha")
    return alone.unionByName(grouped).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"),
    )


@query("op5_exact_dedup", sql="""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))
