"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time, 0 to 1. Its integral is the number of words
the source gives, its target; the words given up to a time are the source's cumulative demand. A
document that begins at some word of its source's stream (its documents in a hashed order, passed
through up to ``most`` times) is therefore trained on at the time at which the demand reaches that
word: the inverse of the integral. Sorting by that time, over ranges of equal length, interleaves
the sources so that every stretch of training has the mix its schedules ask for, and the words
sorted before a document are its position in training.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PLAIN_WORD, hash_bits, read, running_total, stage
from .registry import query

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (5, 2, 1)
#: Tilt of the schedules, repeating likewise: the weight runs in a straight line from 1 - tilt to
#: 1 + tilt times its mean, so common sources lead and small ones come late.
TILTS = (-0.5, 0.0, 0.5)
#: No document is passed more often than this.
MOST = 3


def _cycle(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def source_targets(
    totals: DataFrame, weights: tuple = WEIGHTS, most: float = MOST, tilts: tuple = TILTS
) -> DataFrame:
    """Add weight, tilt and target to a row per source (``source``, ``source_size``).

    The sources share all words by weight; a target stops at ``most`` times its source's words and
    what is over is shared again by weight until no target is above. The result of these rounds is
    a common level: a source gets level times weight, or its stop where that is lower. Sources
    ordered by stop over weight fill up in that order, so the level follows from running sums. The
    table has a row per source, so its windows have no key.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy("stop_ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    stopped = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (
        totals.withColumn("nth", F.row_number().over(by_name) - 1)
        .withColumn("weight", _cycle(weights, F.col("nth")).cast("double"))
        .withColumn("tilt", _cycle(tilts, F.col("nth")).cast("double"))
        .withColumn("stop", F.col("source_size") * F.lit(float(most)))
        .withColumn("stop_ratio", F.col("stop") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything)
                              - F.coalesce(F.sum("stop").over(stopped), F.lit(0.0)))
                    / F.sum("weight").over(rest))
    )
    # The level holds from the first source whose stop it does not reach.
    open_level = F.min(F.when(F.col("stop_ratio") >= F.col("level"), F.struct("stop_ratio", "level")))
    level = open_level.over(everything)["level"]
    return (
        ranked.withColumn("reached", level)
        .withColumn("target", F.least(
            "stop", F.coalesce(F.col("reached") * F.col("weight"), F.col("stop"))
        ))
        .select("source", "source_size", "weight", "tilt", "target")
    )


def _time(words: Column, target: Column, tilt: Column) -> Column:
    """When the demand reaches so many words: the root of tilt t^2 + (1 - tilt) t = words / target."""
    share = words / target
    ahead = F.lit(1.0) - tilt
    return F.lit(2.0) * share / (ahead + F.sqrt(ahead * ahead + F.lit(4.0) * tilt * share))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple = WEIGHTS, most: int = MOST, tilts: tuple = TILTS,
) -> DataFrame:
    """One row per document with its share of the mix.

    doc_id, body_hash (of the text), source, size (words), source_size, target (of its source),
    taken (words the mix takes, repeats counted; the document at which a target is met is taken up
    to that word), copies (passes that take any of it), positions (training time of each) and
    begins (words trained on before each). A null text has size 0, and such documents are taken 0
    times; a null source is a source of its own, the last in order. Rows that repeat id and text
    stand side by side in the stream. The order depends on ids and texts alone, so reruns agree. The
    rows are sorted by ranges of their first begin, those that are not taken last. An empty table
    gives an empty result.
    """
    body, name = F.col(f"`{text}`").cast("string"), F.col(f"`{source}`").cast("string")
    rows = stage(docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("body_hash"), name.alias("source"),
        F.coalesce(F.regexp_count(body, F.lit(PLAIN_WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, tilts
    ).withColumn("source_key", F.xxhash64(F.col("source").isNull(), "source"))
    keyed = rows.select(
        "*", F.xxhash64(F.col("source").isNull(), "source").alias("source_key"),
        hash_bits(F.col("doc_id"), F.col("body_hash")).alias("order"),
    )
    placed = running_total(keyed, ["source_key"], "order", "size", "start")
    # A row per source: as bounded as the list of sources, and left to the planner to broadcast.
    known = placed.join(targets.drop("source"), "source_key")
    goal = F.round("target").cast("long")
    begins = F.transform(
        F.sequence(F.lit(0), F.lit(most - 1)),
        lambda k: F.col("start") + k.cast("long") * F.col("source_size"),
    )
    begun = F.when(F.col("size") > 0, F.filter(begins, lambda at: at < goal)).otherwise(
        F.array().cast("array<bigint>"))
    taken = F.aggregate(
        F.col("begun"), F.lit(0).cast("long"), lambda sum_, at: sum_ + F.least("size", goal - at)
    )
    known = stage(known.withColumn("begun", begun).select(
        "doc_id", "body_hash", "source", "size", "source_size", "target", taken.alias("taken"),
        F.size("begun").alias("copies"), "order", "source_key",
        F.when(F.col("size") > 0, F.col("start")).alias("start"),
        F.transform("begun", lambda at: F.struct(
            _time(at, F.col("target"), F.col("tilt")).alias("time"), F.least("size", goal - at).alias("words")
        )).alias("passes"),
    ))
    # Within its source a document with words is told by its start.
    place = ["source_key", "start"]
    begins = training_positions(known.select(*place, F.posexplode("passes").alias("nth", "pass")).select(
        *place, "nth", "pass.*"))
    begins = begins.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("nth", "begin")))["begin"].alias("begins"))
    rows = known.join(begins, place, "left").select(
        *known.columns[:8], F.col("passes")["time"].alias("positions"),
        F.coalesce("begins", F.array().cast("array<bigint>")).alias("begins"), "order",
    )
    return _in_order(stage(rows), F.get("begins", F.lit(0)).asc_nulls_last(), "order").drop("order")


def training_positions(passes: DataFrame) -> DataFrame:
    """Add ``begin``, the words of all passes (``time`` from 0 to 1, ``words``) with an earlier time.

    Passes go to ranges of time of equal length and are sorted inside them; schedules are straight
    lines, so a range holds at most 1 + tilt times its even share.
    """
    most = (1 << 62) - 1
    timed = passes.withColumn("_all", F.lit(0)).withColumn("_time", F.least(
        (F.col("time") * F.lit(float(1 << 62))).cast("long"), F.lit(most)))
    return running_total(timed, ["_all"], "_time", "words", "begin").drop("_all", "_time")


def _in_order(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Sorted by ranges: files in order give the rows in order."""
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "source", "size", "source_size", "target", "taken",
        F.get("positions", F.lit(0)).alias("position"), F.get("begins", F.lit(0)).alias("begin"),
    )


def in_training_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` in the order of training, each as often as the mix takes any of it.

    The last document that a source gives stays whole. Rows that repeat id and text share the
    positions of one of them. The rows are sorted by ranges of the words before them, so files in
    order give the curriculum.
    """
    one, two, at = "_mix_key", "_mix_text", "_mix_begin"
    mixed = mix(docs, doc_id, text, source)
    places = mixed.groupBy(
        F.xxhash64(F.col("doc_id").isNull(), "doc_id").alias(one), F.col("body_hash").alias(two)
    ).agg(F.min("begins").alias("begins")).where(F.size("begins") > 0)
    key = F.xxhash64(F.col(f"`{doc_id}`").isNull(), F.col(f"`{doc_id}`"))
    body = F.xxhash64(F.col(f"`{text}`").cast("string"))
    passes = docs.withColumn(one, key).withColumn(two, body).join(places, [one, two]).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.explode("begins").alias(at))
    return _in_order(passes, at).drop(at)
