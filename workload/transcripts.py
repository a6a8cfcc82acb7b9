"""``conversations`` written out as assistant transcripts, the way the tools leave them on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions.timeutil import iso_utc
from workload.views import DAY0_MS, load, root

PATTERN = "*.txt"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript lines per conversation.

    A user turn is text or text blocks; an assistant turn is one reply written on two lines with a
    tool call, answered by a result line; a system turn is a compaction; the first turn of every
    conversation is followed by a line that was cut off.
    """
    c = load(spark, sf_dir, "conversations")
    name = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    ms = F.lit(DAY0_MS) + F.col("conv_id") * 600_000 + F.col("turn") * 40_000

    def entry(kind: str, suffix: str, message: Column | None, shift: int = 0, **extra) -> Column:
        fields = [
            F.lit(kind).alias("type"), F.concat(name, F.lit(suffix)).alias("uuid"),
            F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("sessionId"),
            iso_utc(ms + shift).alias("timestamp"), F.lit("/home/dev/app").alias("cwd"),
            F.lit("2.1.0").alias("version"),
            (F.col("conv_id") % 5 == 0).alias("isSidechain"),
        ]
        if message is not None:
            fields.append(message.alias("message"))
        fields += [value.alias(key) for key, value in extra.items()]
        return F.to_json(F.struct(*fields))

    text_block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    tool_id = F.concat(F.lit("tool-"), name)
    call = F.struct(
        F.lit("tool_use").alias("type"), tool_id.alias("id"),
        F.when(F.col("turn") % 3 == 0, "Edit").otherwise("Read").alias("name"),
        F.struct(F.lit("/home/dev/app/main.py").alias("file_path")).alias("input"),
    )
    content = F.to_json(F.array(F.struct(
        text_block["type"].alias("type"), text_block["text"].alias("text"),
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast(call_type()).alias("input"),
    ), F.struct(
        call["type"].alias("type"), F.lit(None).cast("string").alias("text"),
        call["id"].alias("id"), call["name"].alias("name"), call["input"].alias("input"),
    )))
    usage = F.struct(
        F.length("text").alias("input_tokens"), (F.length("text") * 2).alias("output_tokens"),
        F.lit(10).alias("cache_read_input_tokens"),
    )
    reply = F.struct(
        F.concat(F.lit("msg-"), name).alias("id"), F.lit("claude-opus-4-8").alias("model"),
        F.parse_json(content).alias("content"), usage.alias("usage"),
    )
    result = F.struct(F.array(F.struct(
        F.lit("tool_result").alias("type"), tool_id.alias("tool_use_id"),
        (F.col("turn") % 4 == 1).alias("is_error"), F.lit("out").alias("content"),
    )).alias("content"))
    as_text = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    as_blocks = F.struct(F.lit("user").alias("role"), F.array(text_block).alias("content"))
    broken = F.when(F.col("turn") == 0, F.lit('{"type":"user","broken json'))
    out = F.when(
        F.col("role") == "user",
        F.array(F.when(F.col("turn") % 4 == 0, entry("user", "-u", as_text))
                .otherwise(entry("user", "-u", as_blocks)), broken),
    ).when(
        F.col("role") == "assistant",
        F.array(entry("assistant", "-a", reply), entry("assistant", "-b", reply, 2000),
                entry("user", "-r", result, 5000), broken),
    ).otherwise(
        F.array(entry("system", "-s", None,
                      compactMetadata=F.struct(F.lit("auto").alias("trigger"))), broken)
    )
    folder = F.concat(F.lit("app"), (F.col("conv_id") % 7).cast("string"))
    return c.select(folder.alias("folder"), F.explode(F.array_compact(out)).alias("value"))


def call_type() -> str:
    return "struct<file_path:string>"


_WRITTEN: set[str] = set()


def directory(spark: SparkSession, sf_dir: str) -> str:
    path = f"{root(spark, sf_dir)}/transcripts"
    if path not in _WRITTEN:
        lines(spark, sf_dir).write.partitionBy("folder").mode("overwrite").text(path)
        _WRITTEN.add(path)
    return path
