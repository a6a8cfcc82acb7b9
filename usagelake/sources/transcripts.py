"""Transcript JSONL: discovery, tolerant reading, mapping to events, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelake.functions.exprs import strip

# Identity of the transcript source and limits of the scan.
PROVIDER_ID = "claude-code"
PRODUCT_NAME = "Claude Code"
DRIFT_MIN_SAMPLE = 50
DRIFT_MIN_COVERAGE = 0.5
HEAD_BYTES = 4096

_EVENT = (
    "struct<external_id:string,event_type:string,model:string,prompt:string,response:string,"
    "tool_name:string,input_tokens:bigint,output_tokens:bigint,cache_read_tokens:bigint,"
    "cache_write_tokens:bigint,cache_write_1h_tokens:bigint,metadata:string>"
)


def read_lines(
    spark: SparkSession, directory: str, modified_after: str | None = None,
    pattern: str = "*.jsonl",
) -> DataFrame:
    """Lines of every transcript file below a directory, with where they came from.

    A grown file is simply read again: the merge is idempotent, so no byte offsets are kept.
    ``modified_after`` prunes files that have not changed since the last scan.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    return _located(reader.option("lineSep", "\n").text(directory))


def stream_lines(
    spark: SparkSession, directory: str, max_files: int = 1000, pattern: str = "*.jsonl"
) -> DataFrame:
    """The same lines as a stream over immutable (rotated) transcript files."""
    stream = (
        spark.readStream.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .option("lineSep", "\n")
        .text(directory)
    )
    return _located(stream)


def _located(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
        F.col("_metadata.file_block_start").alias("block_start"),
    )


def discover(spark: SparkSession, directory: str, pattern: str = "*.jsonl") -> DataFrame:
    """Transcript files with size and age, oldest first. No file is opened; empty ones, which hold no
    event yet, are left out by Spark's listing."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern).load(directory)
    )
    return listed.select(
        F.col("path").alias("source_path"), F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified_at"),
    ).orderBy("modified_at", "source_path")


def changed_files(current: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Files to read again, and whether from the start.

    ``current`` and ``watermarks`` hold ``source_path, file_size, head_hash``. A file that shrank
    or whose head changed was rewritten; one that grew was appended to; others are skipped.
    """
    old = watermarks.select(
        "source_path", F.col("file_size").alias("old_size"), F.col("head_hash").alias("old_hash")
    )
    restart = (F.col("file_size") < F.col("old_size")) | ~F.col("head_hash").eqNullSafe(
        F.col("old_hash")
    )
    reason = (
        F.when(F.col("old_size").isNull(), "new")
        .when(restart, "rewritten")
        .when(F.col("file_size") > F.col("old_size"), "appended")
        .otherwise("unchanged")
    )
    return current.join(old, "source_path", "left").withColumn("reason", reason).where(
        F.col("reason") != "unchanged"
    ).drop("old_size", "old_hash")


def file_heads(spark: SparkSession, directory: str, pattern: str = "*.jsonl") -> DataFrame:
    """Size and hash of the first 4 KB of each transcript, for rewrite detection.

    Files of any size are read line by line, and the lines of a block are in order within their
    task. Only the lines that begin in the first 4 KB are put together again; every line but an
    unfinished last one ends in a line feed, so the file's own size tells where the head ends.
    """
    lines = read_lines(spark, directory, pattern=pattern).where(F.col("block_start") < HEAD_BYTES)
    placed = lines.select(
        "source_path", "file_size", "block_start", F.monotonically_increasing_id().alias("at"),
        (F.octet_length("value") + 1).alias("length"),
        F.substring(F.concat(F.col("value").cast("binary"), F.lit(b"\n")), 1, HEAD_BYTES).alias("head"),
    )
    earlier = Window.partitionBy("source_path").orderBy("block_start", "at").rowsBetween(
        Window.unboundedPreceding, -1
    )
    first = placed.withColumn("start", F.coalesce(F.sum("length").over(earlier), F.lit(0))).where(
        F.col("start") < HEAD_BYTES
    )
    parts = F.array_sort(F.collect_list(F.struct("start", F.hex("head").alias("head"))))
    files = first.groupBy("source_path").agg(
        F.max("file_size").alias("file_size"), F.array_join(parts["head"], "").alias("head")
    )
    size = F.least(F.col("file_size"), F.lit(HEAD_BYTES)).cast("int")
    return files.select(
        "source_path", "file_size",
        F.sha2(F.substring(F.unhex("head"), F.lit(1), size), 256).alias("head_hash"),
    )


def parse(lines: DataFrame) -> DataFrame:
    """Lines parsed as VARIANT; a broken line has a null record and is counted, not fatal."""
    return lines.where(strip(F.col("value")) != "").withColumn(
        "record", F.try_parse_json("value")
    )


def parse_report(parsed: DataFrame) -> DataFrame:
    """Records and parse errors per file."""
    return parsed.groupBy("source_path").agg(
        F.count("record").alias("records"),
        F.count(F.when(F.col("record").isNull(), 1)).alias("parse_errors"),
    )


def _get(path: str, kind: str = "string", source: Column | str = "record") -> Column:
    column = F.col(source) if isinstance(source, str) else source
    return F.try_variant_get(column, path, kind)


def _truthy(path: str) -> Column:
    return F.coalesce(_get(path), F.lit("")) .isin("", "false", "0") == F.lit(False)


def _object_json(**fields: Column) -> Column:
    """JSON object of the non-empty fields, null when there are none."""
    entries = F.struct(*[F.nullif(v, F.lit("")).alias(k) for k, v in fields.items()])
    return F.nullif(F.to_json(entries), F.lit("{}"))


def _event(kind: str, external_id: Column, **fields: Column) -> Column:
    names = [part.split(":")[0] for part in _EVENT[len("struct<"):-1].split(",")]
    known = {"event_type": F.lit(kind), "external_id": external_id, **fields}
    return F.struct(
        *[known.get(n, F.lit(None)).alias(n) for n in names]
    ).cast(_EVENT)


def _one_if(condition: Column, event: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(event)).otherwise(
        F.array().cast(f"array<{_EVENT}>")
    )


def with_fields(parsed: DataFrame) -> DataFrame:
    """Typed fields of each record, read once and shared by every mapping rule."""
    content = F.variant_get("record", "$.message.content", "variant")
    blocks = F.try_variant_get("record", "$.message.content", "array<variant>")
    typed = parsed.where(F.col("record").isNotNull()).select(
        *[c for c in parsed.columns if c != "value"],
        _get("$.type").alias("type"),
        _get("$.uuid").alias("uuid"),
        _get("$.timestamp").alias("timestamp"),
        _get("$.sessionId").alias("session_id"),
        _get("$.parentUuid").alias("parent_event_id"),
        F.coalesce(_get("$.isSidechain", "boolean"), F.lit(False)).alias("is_subagent"),
        _get("$.cwd").alias("working_directory"),
        _get("$.gitBranch").alias("git_branch"),
        _get("$.version").alias("source_version"),
        _get("$.message.model").alias("model"),
        F.when(F.schema_of_variant(content) == "STRING", _get("$.message.content"))
        .alias("content_text"),
        F.transform(
            blocks,
            lambda b: F.struct(
                _get("$.type", source=b).alias("type"),
                _get("$.text", source=b).alias("text"),
                _get("$.name", source=b).alias("name"),
                _get("$.id", source=b).alias("id"),
                _get("$.tool_use_id", source=b).alias("tool_use_id"),
                F.coalesce(_get("$.is_error", "boolean", b), F.lit(False)).alias("is_error"),
                F.coalesce(
                    _get("$.input.file_path", source=b), _get("$.input.path", source=b),
                    _get("$.input.notebook_path", source=b),
                ).alias("file_path"),
            ),
        ).alias("blocks"),
    )
    texts = F.transform(
        F.filter("blocks", lambda b: (b["type"] == "text") & b["text"].isNotNull()),
        lambda b: b["text"],
    )
    return typed.withColumn(
        "plain_text",
        F.coalesce("content_text", strip(F.array_join(texts, "\n")), F.lit("")),
    )


def is_human_prompt() -> Column:
    """Text typed by a person: not injected, not blank and not the answer of a tool."""
    has_text = F.exists(
        "blocks",
        lambda b: (b["type"] == "text") & (strip(F.coalesce(b["text"], F.lit(""))) != ""),
    )
    has_result = F.exists("blocks", lambda b: F.coalesce(b["type"], F.lit("")) == "tool_result")
    typed = F.when(
        F.col("content_text").isNotNull(), strip(F.col("content_text")) != ""
    ).otherwise(F.coalesce(has_text & ~has_result, F.lit(False)))
    return (F.col("type") == "user") & ~_truthy("$.isMeta") & typed


def map_records(parsed: DataFrame, store_responses: bool = False) -> DataFrame:
    """Source events of every record: prompt, response, tool calls, compaction, error.

    One scan: the branches are arrays concatenated and exploded, not a union of passes. Records
    without a readable timestamp give nothing.
    """
    fields = with_fields(parsed)
    assistant = F.col("type") == "assistant"
    text = F.col("plain_text")

    def tokens(path: str) -> Column:
        return _get(f"$.message.usage.{path}", "bigint")

    prompt = _event(
        "prompt", F.coalesce("uuid", _get("$.promptId"), F.lit("undefined")), prompt=text,
        metadata=_object_json(
            promptId=_get("$.promptId"), promptSource=_get("$.promptSource"),
            permissionMode=_get("$.permissionMode"), effort=_get("$.effort"),
            entrypoint=_get("$.entrypoint"),
        ),
    )
    has_usage = F.coalesce(
        F.schema_of_variant(F.variant_get("record", "$.message.usage", "variant")), F.lit("VOID")
    ).startswith("OBJECT")
    response = _event(
        "response", F.coalesce(_get("$.message.id"), F.col("uuid"), _get("$.requestId")),
        model=F.col("model"),
        input_tokens=tokens("input_tokens"),
        output_tokens=tokens("output_tokens"),
        cache_read_tokens=tokens("cache_read_input_tokens"),
        cache_write_tokens=tokens("cache_creation_input_tokens"),
        cache_write_1h_tokens=tokens("cache_creation.ephemeral_1h_input_tokens"),
        response=F.nullif(text, F.lit("")) if store_responses else F.lit(None).cast("string"),
        metadata=_object_json(
            stopReason=_get("$.message.stop_reason"),
            serviceTier=_get("$.message.usage.service_tier"), requestId=_get("$.requestId"),
        ),
    )
    calls = F.filter("blocks", lambda b: (b["type"] == "tool_use") & b["name"].isNotNull())
    tools = F.transform(
        calls,
        lambda b: _event(
            "tool_call",
            F.coalesce(
                b["id"], F.concat(F.coalesce("uuid", F.lit("undefined")), F.lit("-"), b["name"])
            ),
            model=F.col("model"), tool_name=b["name"],
            metadata=_object_json(filePath=b["file_path"]),
        ),
    )
    no_events = F.array().cast(f"array<{_EVENT}>")
    compaction = _event(
        "compaction",
        F.coalesce("uuid", F.concat(F.coalesce("session_id", F.lit("undefined")),
                                    F.lit("-compaction"))),
        metadata=F.lit('{"compaction":true}'),
    )
    error = _event(
        "error",
        F.coalesce("uuid", F.concat(F.coalesce("session_id", F.lit("undefined")),
                                    F.lit("-error"))),
        metadata=F.lit('{"kind":"api_error"}'),
    )
    events = F.concat(
        _one_if(is_human_prompt() & (text != ""), prompt),
        _one_if(assistant & (has_usage | (F.coalesce("model", F.lit("")) != "")), response),
        F.coalesce(F.when(assistant, tools), no_events),
        _one_if(_truthy("$.compactMetadata"), compaction),
        _one_if(_truthy("$.isApiErrorMessage"), error),
    )
    readable = F.expr("try_cast(`timestamp` AS TIMESTAMP)").isNotNull()
    out = fields.where(readable).select(
        F.lit(PROVIDER_ID).alias("provider_id"), F.lit(PRODUCT_NAME).alias("product"),
        "timestamp", "session_id", "parent_event_id", "is_subagent", "working_directory",
        "git_branch", "source_version", F.explode(events).alias("event"),
    )
    return out.select(
        *[c for c in out.columns if c != "event"], "event.*",
        F.lit(None).cast("boolean").alias("tool_succeeded"),
    )


def tool_outcomes(parsed: DataFrame) -> DataFrame:
    """Whether each answered tool call succeeded, and when that was said (``at``); the latest answer
    counts."""
    answers = (
        with_fields(parsed)
        .where(F.col("type") == "user")
        .select(
            "timestamp",
            F.explode(
                F.filter(
                    "blocks",
                    lambda b: (b["type"] == "tool_result") & b["tool_use_id"].isNotNull(),
                )
            ).alias("b"),
        )
    )
    return answers.groupBy(F.col("b.tool_use_id").alias("external_id")).agg(
        F.max_by(~F.col("b.is_error"), F.coalesce("timestamp", F.lit(""))).alias("outcome"),
        F.max(F.coalesce("timestamp", F.lit(""))).alias("at"),
    )


def resolve_outcomes(events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Fill unknown tool outcomes over the whole data, wherever the answer was written."""
    calls = F.col("event_type") == "tool_call"
    answered = events.where(calls).join(outcomes.select("external_id", "outcome"), "external_id", "left").withColumn(
        "tool_succeeded", F.coalesce("tool_succeeded", "outcome")
    ).drop("outcome").select(*events.columns)
    return events.where(~calls).unionByName(answered)


def transcript_events(parsed: DataFrame, store_responses: bool = False) -> DataFrame:
    return resolve_outcomes(map_records(parsed, store_responses), tool_outcomes(parsed))


# Fields whose disappearance would degrade the analytics.
TRACKED_FIELDS = (
    ("timestamp", "$.timestamp", None),
    ("sessionId", "$.sessionId", None),
    ("uuid", "$.uuid", None),
    ("cwd", "$.cwd", None),
    ("version", "$.version", None),
    ("message.model", "$.message.model", "assistant"),
    ("message.usage", "$.message.usage", "assistant"),
)


def drift_report(parsed: DataFrame) -> DataFrame:
    """Share of records carrying each tracked field, and whether that is worth a warning."""
    records = parsed.where(F.col("record").isNotNull())
    counts = []
    for name, path, only in TRACKED_FIELDS:
        applies = F.lit(True) if only is None else (_get("$.type") == only)
        present = applies & F.coalesce(
            F.variant_get("record", path, "variant").isNotNull()
            & ~F.is_variant_null(F.variant_get("record", path, "variant"))
            & (F.coalesce(_get(path), F.lit("x")) != ""),
            F.lit(False),
        )
        counts.append(
            F.struct(
                F.lit(name).alias("field"),
                F.count(F.when(applies, 1)).alias("applicable"),
                F.count(F.when(present, 1)).alias("present"),
            )
        )
    long = records.agg(F.array(*counts).alias("fields")).select(F.explode("fields").alias("f"))
    coverage = F.when(F.col("applicable") == 0, F.lit(1.0)).otherwise(
        F.col("present") / F.nullif(F.col("applicable"), F.lit(0))
    )
    return long.select("f.*").withColumn("coverage", coverage).withColumn(
        "warning",
        (F.col("applicable") >= DRIFT_MIN_SAMPLE) & (F.col("coverage") < DRIFT_MIN_COVERAGE),
    )


def source_summary(parsed: DataFrame) -> DataFrame:
    """Files, bytes, project directories and the newest version seen, as one row."""
    files = parsed.groupBy("source_path").agg(
        F.max("file_size").alias("bytes"),
        F.max("modified_at").alias("modified_at"),
        F.max(_get("$.version")).alias("version"),
    )
    folder = F.regexp_extract("source_path", r"^(.*)/[^/]+\z", 1)
    return files.agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("bytes").alias("bytes"),
        F.count_distinct(folder).alias("project_directories"),
        F.max_by("version", F.when(F.col("version").isNotNull(), F.struct("modified_at", "source_path"))
                 ).alias("newest_version"),
    )


# Lifecycle hooks that become events.
HOOK_EVENTS = {
    "SessionStart": "session_start",
    "SessionEnd": "session_end",
    "PreCompact": "compaction",
    "PostCompact": "compaction",
    "Notification": "notification",
}

HOOK_SCHEMA = (
    "hook_event_name string, session_id string, prompt_id string, transcript_path string, "
    "cwd string, permission_mode string, reason string, model string, agent_id string, "
    "agent_type string, effort string, received_at string"
)


def map_hooks(payloads: DataFrame) -> DataFrame:
    """Lifecycle hook payloads as source events; hooks that mark nothing are dropped."""
    lookup = F.create_map(*[F.lit(x) for pair in HOOK_EVENTS.items() for x in pair])
    kind = F.try_element_at(lookup, F.col("hook_event_name"))
    return payloads.withColumn("event_type", kind).where(F.col("event_type").isNotNull()).select(
        F.lit(PROVIDER_ID).alias("provider_id"),
        F.lit(PRODUCT_NAME).alias("product"),
        F.concat_ws(
            ":", F.lit("hook"), "hook_event_name", F.coalesce("session_id", F.lit("unknown")),
            "received_at",
        ).alias("external_id"),
        "event_type",
        F.col("received_at").alias("timestamp"),
        "session_id",
        (F.coalesce("agent_id", F.lit("")) != "").alias("is_subagent"),
        F.col("cwd").alias("working_directory"),
        "model",
        F.to_json(
            F.struct(
                F.col("hook_event_name").alias("hookEvent"), "reason",
                F.col("permission_mode").alias("permissionMode"),
                F.col("agent_type").alias("agentType"), F.lit("hook").alias("source"),
            )
        ).alias("metadata"),
    )
