"""From source events to the stored event contract."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.contract import EVENT_INPUT, EVENT_TYPES, INGEST_VERSION, Settings, Tables
from usagelake.functions import ids, timeutil
from usagelake.functions import text as tx
from usagelake.functions.exprs import let, utf16_length
from usagelake.functions.pricing import Usage, estimate_cost_usd, price_of
from usagelake.functions.redaction import RESULT, redact, redact_json

# Longest accepted value per text column of the input contract.
MAX_LENGTH = {
    "external_id": 256, "product": 128, "model": 128, "session_id": 256, "parent_event_id": 256,
    "working_directory": 4096, "repository": 512, "git_branch": 256, "tool_name": 128,
    "source_version": 64,
}
NON_NEGATIVE = (
    "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
    "cache_write_1h_tokens", "duration_ms",
)
MIN_MS = -62_135_596_800_000  # 0001-01-01T00:00:00Z
MAX_MS = 253_402_300_799_999  # 9999-12-31T23:59:59.999Z

EVENT_COLUMNS = (
    "event_id", "dedupe_key", "provider_id", "product", "model", "model_family", "ts", "ts_ms",
    "tz_offset_minutes", "local_date", "local_hour", "local_weekday", "session_id", "external_id",
    "parent_event_id", "is_subagent", "project_id", "working_directory", "repository",
    "git_branch", "event_type", "input_tokens", "output_tokens", "cache_read_tokens",
    "cache_write_tokens", "estimated_cost_usd", "duration_ms", "source_version",
    "ingest_version", "enrichment_version", "metadata",
)


def conform(df: DataFrame, provider_id: str | None = None) -> DataFrame:
    """Give a source frame every contract column, missing ones as null.

    The batch's provider fills events that name none.
    """
    columns = []
    for field in EVENT_INPUT.fields:
        if field.name not in df.columns:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif field.name == "timestamp":
            columns.append(F.col("timestamp"))
        else:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in EVENT_INPUT.fieldNames()]
    out = df.select(*columns, *extra)
    if provider_id:
        out = out.withColumn("provider_id", F.coalesce("provider_id", F.lit(provider_id)))
    return out


def _instant(df: DataFrame) -> Column:
    """Timestamp of the event, null when it cannot be read."""
    if dict(df.dtypes)["timestamp"] == "string":
        return F.when(
            F.length("timestamp") >= 4, F.expr("try_cast(`timestamp` AS TIMESTAMP)")
        )
    return F.col("timestamp").cast("timestamp")


def failed_rules(df: DataFrame) -> Column:
    """Names of the contract rules a row breaks; empty for a valid row."""
    ms = timeutil.epoch_ms(_instant(df))
    checks = {
        "provider_id": F.coalesce(F.length("provider_id"), F.lit(0)).between(1, 64),
        "timestamp": F.coalesce(ms.between(MIN_MS, MAX_MS), F.lit(False)),
        "tz_offset_minutes": F.coalesce(F.col("tz_offset_minutes").between(-900, 900), F.lit(True)),
        "event_type": F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False)),
    }
    for column, limit in MAX_LENGTH.items():
        checks[column] = F.coalesce(F.length(column) <= limit, F.lit(True))
    for column in NON_NEGATIVE:
        checks[column] = F.coalesce(F.col(column) >= 0, F.lit(True))
    return F.filter(
        F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]),
        lambda name: name.isNotNull(),
    )


def validate(df: DataFrame) -> DataFrame:
    """Add ``failed_rules`` and ``is_valid``; an invalid row is counted, never fatal."""
    marked = df.withColumn("failed_rules", failed_rules(df))
    return marked.withColumn("is_valid", F.size("failed_rules") == 0)


def drop_paused(df: DataFrame, providers: DataFrame) -> DataFrame:
    """Events of providers that are accepting data; a provider never seen before is."""
    paused = providers.where(~F.col("enabled")).select("provider_id")
    return df.join(paused, "provider_id", "left_anti")


def register_providers(events: DataFrame, providers: DataFrame) -> DataFrame:
    """Rows for providers that appear in the events but not in the dimension."""
    seen = events.select("provider_id").where(F.col("provider_id").isNotNull()).distinct()
    return seen.join(providers.select("provider_id"), "provider_id", "left_anti").select(
        "provider_id", ids.display_name(F.col("provider_id")).alias("name"),
        F.lit(True).alias("enabled"),
    )


def normalize(
    df: DataFrame, settings: Settings | None = None, project_root: Column | None = None,
    with_kinds: bool = False,
) -> DataFrame:
    """One stored event per valid source event, with its prompt, response and tool structs.

    ``project_root`` names the directory a project is keyed on; by default the working directory
    itself (see ``operators.projects.resolve_roots`` for repository roots).
    """
    settings = settings or Settings()
    df = conform(df)
    root = project_root if project_root is not None else F.col("working_directory")
    instant = _instant(df)
    staged = df.withColumn("ts_ms", timeutil.epoch_ms(instant)).withColumn(
        "tz_offset_minutes",
        F.coalesce(
            "tz_offset_minutes", timeutil.zone_offset_minutes(instant, settings.timezone)
        ),
    )
    iso = timeutil.iso_utc(F.col("ts_ms"))
    identity = ids.content_identity({c: F.col(c) for c in df.columns})
    key = ids.dedupe_key(
        F.col("provider_id"), F.col("external_id"), F.col("event_type"), iso,
        F.col("tool_name"), identity,
    )
    usage = Usage(
        F.col("input_tokens"), F.col("output_tokens"), F.col("cache_read_tokens"),
        F.col("cache_write_tokens"), F.col("cache_write_1h_tokens"),
    )
    offset = F.col("tz_offset_minutes")
    ms = F.col("ts_ms")
    metadata = redact_json(F.col("metadata")) if settings.redact_secrets else F.col("metadata")
    keyed = staged.withColumn("dedupe_key", key).withColumn("price", price_of(F.col("model")))
    events = keyed.select(
        ids.event_id(F.col("dedupe_key")).alias("event_id"),
        "dedupe_key",
        "provider_id",
        "product",
        "model",
        ids.model_family(F.col("model")).alias("model_family"),
        F.timestamp_millis(ms).alias("ts"),
        "ts_ms",
        offset.alias("tz_offset_minutes"),
        timeutil.local_date(ms, offset).alias("local_date"),
        timeutil.local_hour(ms, offset).alias("local_hour"),
        timeutil.local_weekday(ms, offset).alias("local_weekday"),
        ids.session_key(F.col("provider_id"), F.col("session_id")).alias("session_id"),
        F.col("session_id").alias("external_session_id"),
        "external_id",
        "parent_event_id",
        F.coalesce("is_subagent", F.lit(False)).alias("is_subagent"),
        ids.project_key(root).alias("project_id"),
        root.alias("project_path"),
        "working_directory",
        "repository",
        "git_branch",
        "event_type",
        "input_tokens",
        "output_tokens",
        "cache_read_tokens",
        "cache_write_tokens",
        estimate_cost_usd(F.col("price"), usage).alias("estimated_cost_usd"),
        "duration_ms",
        "source_version",
        F.lit(INGEST_VERSION).alias("ingest_version"),
        F.lit(0).alias("enrichment_version"),
        metadata.alias("metadata"),
        _planned(prompt_row, settings, with_kinds).alias("prompt"),
        _planned(response_row, settings).alias("response"),
        tool_row().alias("tool_call"),
    )
    return events


_PLANNED: dict[tuple, Column] = {}


def _planned(build, settings: Settings, *args) -> Column:
    """The text columns are long expressions that depend on the settings alone; every batch of a
    stream uses the same ones, so they are built once per JVM."""
    key = (id(SparkContext._gateway), build.__name__, settings.redact_secrets,
           settings.metadata_only, settings.store_responses, *args)
    if key not in _PLANNED:
        _PLANNED[key] = build(settings, *args)
    return _PLANNED[key]


def prompt_row(settings: Settings, with_kinds: bool = False) -> Column:
    """Stored form of a prompt; measures are of the original text, only the text is redacted."""
    raw = F.col("prompt")
    if settings.redact_secrets:
        redacted = redact(raw)
    else:
        redacted = F.struct(
            raw.alias("text"), F.lit(0).alias("count"),
            F.array().cast("array<string>").alias("kinds"),
        ).cast(RESULT)
    keep = F.lit(not settings.metadata_only)

    def build(r: Column) -> Column:
        return let(tx.collapsed(raw), lambda flat: row(r, flat))

    def row(r: Column, flat: Column) -> Column:
        # What nothing was cut from needs no second pass for its preview.
        shown = F.when(r["count"] == 0, flat).otherwise(tx.collapsed(r["text"]))
        fields = [
            F.when(keep, r["text"]).alias("text"),
            tx.text_hash(raw).alias("text_hash"),
            tx.fingerprint(raw).alias("normalized_hash"),
            utf16_length(raw).alias("char_length"),
            tx.words_in(flat).alias("word_length"),
            r["count"].alias("redaction_count"),
            # An empty stored text has no preview.
            F.when(keep & (r["text"] != ""), let(shown, lambda s: tx.shortened(s))).alias("preview"),
        ]
        if with_kinds:
            fields.append(r["kinds"].alias("redaction_kinds"))
        return F.struct(*fields)

    is_prompt = (F.col("event_type") == "prompt") & raw.isNotNull()
    return F.when(is_prompt, let(redacted, build))


def response_row(settings: Settings) -> Column:
    """Response length always; its text only when retention of replies is switched on."""
    raw = F.col("response")
    is_response = (F.col("event_type") == "response") & raw.isNotNull()
    if not settings.store_responses or settings.metadata_only:
        stored, count = F.lit(None).cast("string"), F.lit(0)
    elif settings.redact_secrets:
        result = redact(raw)
        stored, count = result["text"], result["count"]
    else:
        stored, count = raw, F.lit(0)
    return F.when(
        is_response,
        F.struct(
            stored.alias("text"), utf16_length(raw).alias("char_length"),
            count.cast("int").alias("redaction_count"),
        ),
    )


def tool_row() -> Column:
    path = F.get_json_object("metadata", "$.filePath")
    is_call = (F.col("event_type") == "tool_call") & (
        F.coalesce(F.col("tool_name"), F.lit("")) != ""
    )
    return F.when(
        is_call,
        F.struct(
            F.col("tool_name").alias("tool_name"),
            F.col("tool_succeeded").alias("succeeded"),
            F.col("duration_ms").alias("duration_ms"),
            tx.extension_of_path(path).alias("target_extension"),
        ),
    )


def split_tables(normalized: DataFrame) -> Tables:
    """The wide normalised frame as the event table and its 1:1 side tables."""

    def side(name: str) -> DataFrame:
        rows = normalized.where(F.col("event_type") == name)
        extra = ["local_date", "provider_id"] + (["session_id"] if name == "tool_call" else [])
        # Exploding evaluates the struct once; selecting its fields would repeat it per field.
        present = F.explode(F.array_compact(F.array(name))).alias("row")
        return rows.select("event_id", *extra, present).select("event_id", *extra, "row.*")

    return Tables(
        events=normalized.select(*EVENT_COLUMNS, "external_session_id", "project_path"),
        prompts=side("prompt"),
        responses=side("response"),
        tool_calls=side("tool_call"),
    )


def stored_tables(log: DataFrame) -> Tables:
    """The same tables as column-pruned views of a normalised log that was written out."""

    def side(name: str) -> DataFrame:
        extra = ["local_date", "provider_id"] + (["session_id"] if name == "tool_call" else [])
        return log.where((F.col("event_type") == name) & F.col(name).isNotNull()).select(
            "event_id", *extra, f"{name}.*"
        )

    return Tables(
        events=log.select(*EVENT_COLUMNS, "external_session_id", "project_path"),
        prompts=side("prompt"),
        responses=side("response"),
        tool_calls=side("tool_call"),
    )


def project_rows(normalized: DataFrame, remotes: DataFrame | None = None) -> DataFrame:
    """Project dimension seen in a batch: one row per project with first and last sighting.

    ``remotes(project_path, git_remote)`` supplies the repository of roots that have one.
    """
    seen = (
        normalized.where(F.col("project_id").isNotNull())
        .groupBy("project_id", F.col("project_path").alias("path"))
        .agg(F.min("ts_ms").alias("first_seen_ms"), F.max("ts_ms").alias("last_seen_ms"))
    )
    if remotes is None:
        remote = F.lit(None).cast("string")
    else:
        seen = seen.join(
            remotes.select(F.col("project_path").alias("path"), "git_remote"), "path", "left"
        )
        remote = F.col("git_remote")
    return seen.select(
        "project_id", "path", ids.project_name(F.col("path")).alias("name"),
        ids.repository_name(remote).alias("repository"), remote.alias("git_remote"),
        "first_seen_ms", "last_seen_ms",
    )
