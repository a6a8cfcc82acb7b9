"""Prompt-level answers: search, detail, repetition, length, themes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.contract import EventFilters, Tables
from usagelake.functions import text as tx
from usagelake.operators.asof import next_responses
from usagelake.operators.filters import after_cursor, apply_filters, event_predicate, prune
from usagelake.rules.words import STOP_WORDS

MIN_REPEAT_LENGTH = 12


def query_tokens(query: str) -> list[str]:
    """Bare lower-case tokens of a search query."""
    tokens = re.split(r"[^\w]+", query.lower())
    return [t for t in tokens if t]


def matches(text: Column, query: str) -> Column:
    """Every query token starts some token of the text, case and diacritics aside.

    A query without any token matches nothing.
    """
    tokens = query_tokens(query)
    if not tokens:
        return F.lit(False)
    haystack = tx.searchable(text)
    return reduce(
        lambda a, b: a & b, [F.contains(haystack, tx.searchable(F.lit(t))) for t in tokens]
    )


def _technology_lists(technologies: DataFrame, ids: DataFrame) -> DataFrame:
    return (
        technologies.select("event_id", "technology")
        .join(ids, "event_id", "left_semi")
        .groupBy("event_id")
        .agg(F.array_sort(F.collect_set("technology")).alias("technologies"))
    )


def search(
    tables: Tables, f: EventFilters | None = None, query: str | None = None,
    limit: int = 50, cursor: tuple[int, str] | None = None, index: DataFrame | None = None,
) -> DataFrame:
    """Page of prompts, newest first, ``limit + 1`` rows so the caller knows there are more.

    With an ``index`` of the same prompts (``term_rows``) no text is read.
    """
    bounded = f is not None and index is not None and (f.from_day or f.to_day)
    if bounded:
        index = index.where(event_predicate(EventFilters(from_day=f.from_day, to_day=f.to_day)))
    tables = prune(tables, f)
    prompts = apply_filters(tables, f, event_type="prompt")
    if cursor is not None:
        prompts = prompts.where(after_cursor(*cursor))
    texts = tables.prompts
    if query is not None and query.strip():
        if index is not None:
            texts = texts.join(search_index(index, query), "event_id", "left_semi")
        else:
            texts = texts.where(matches(F.col("text"), query))
    found = prompts.join(
        texts.select("event_id", "preview", "char_length", "word_length", "redaction_count"),
        "event_id",
    )
    page = found.orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(limit + 1)
    return describe_prompts(tables, page)


def describe_prompts(tables: Tables, page: DataFrame) -> DataFrame:
    """Names, classification and technologies for a bounded page of prompts."""
    ids = page.select("event_id")
    labels = tables.classifications.select(
        "event_id", "category", F.col("confidence").alias("category_confidence")
    ).join(ids, "event_id", "left_semi")
    return (
        page.join(
            tables.providers.select("provider_id", F.col("name").alias("provider_name")),
            "provider_id", "left",
        )
        .join(
            tables.projects.select("project_id", F.col("name").alias("project_name")),
            "project_id", "left",
        )
        .join(labels, "event_id", "left")
        .join(_technology_lists(tables.technologies, ids), "event_id", "left")
        .select(
            "event_id", "ts_ms", "provider_id", "provider_name", "model", "project_id",
            "project_name", "session_id", "category", "category_confidence", "preview",
            "char_length", "word_length", "redaction_count", "is_subagent", "input_tokens",
            "output_tokens",
            F.coalesce("technologies", F.array().cast("array<string>")).alias("technologies"),
        )
        .orderBy(F.desc("ts_ms"), F.desc("event_id"))
    )


def term_rows(prompts: DataFrame) -> DataFrame:
    """Postings: every different token of a stored text with its event, day and provider.

    Stored by day and sorted by token, they answer a prefix from the row groups whose range of
    tokens it lies in, on the days asked for.
    """
    tokens = F.split(F.trim(tx.searchable(F.col("text"))), " ")
    return (
        prompts.where(F.col("text").isNotNull())
        .select("event_id", "local_date", "provider_id", F.explode(F.array_distinct(tokens)).alias("token"))
        .where(F.col("token") != "")
    )


def token_index(tables: Tables) -> DataFrame:
    """Distinct (token, event) pairs for repeated searching.

    Written sorted by token it answers a prefix with a pruned range scan instead of reading texts.
    """
    return term_rows(tables.prompts).select("event_id", "token")


def write_token_index(tables: Tables, path: str) -> None:
    """Range-partitioned by token and event, so a frequent token spans several files."""
    token_index(tables).repartitionByRange("token", "event_id").sortWithinPartitions(
        "token", "event_id"
    ).write.mode("overwrite").parquet(path)


def search_index(index: DataFrame, query: str) -> DataFrame:
    """Events holding every query token as a prefix, from the token index."""
    phrases = [p for t in query_tokens(query) for p in t.split("_") if p]
    if not phrases:
        return index.select("event_id").where(F.lit(False))
    spark = index.sparkSession
    folded = spark.range(1).select(
        *[F.trim(tx.searchable(F.lit(p))).alias(f"p{i}") for i, p in enumerate(phrases)]
    ).first()
    wanted = [p for p in dict.fromkeys(folded) if p]
    if not wanted:
        return index.select("event_id").where(F.lit(False))
    any_of = reduce(lambda a, b: a | b, [F.col("token").startswith(p) for p in wanted])
    hits = index.where(any_of).groupBy("event_id").agg(
        *[F.max(F.col("token").startswith(p)).alias(f"has_{i}") for i, p in enumerate(wanted)]
    )
    every = reduce(lambda a, b: a & b, [F.col(f"has_{i}") for i in range(len(wanted))])
    return hits.where(every).select("event_id")


def detail(tables: Tables, event_id: str) -> DataFrame:
    """One prompt with its text, its next response and everything known about it."""
    return details(tables, tables.events.where(F.col("event_id") == event_id))


def details(tables: Tables, prompts: DataFrame) -> DataFrame:
    """Prompt details for the given prompt events, looked up by session rather than per row."""
    chosen = prompts.where(F.col("event_type") == "prompt")
    sessions = chosen.select("session_id").distinct()
    around = tables.events.join(sessions, "session_id", "left_semi")
    replies = next_responses(around, tables.responses).select("event_id", "response_text")
    ids = chosen.select("event_id")
    technologies = tables.technologies.join(ids, "event_id", "left_semi").groupBy("event_id").agg(
        F.array_sort(F.collect_set("technology")).alias("technologies")
    )
    contexts = tables.contexts.join(ids, "event_id", "left_semi").groupBy("event_id").agg(
        F.array_sort(F.collect_set("context")).alias("contexts")
    )
    nothing = F.array().cast("array<string>")
    return (
        chosen.join(
            tables.prompts.select(
                "event_id", "text", "preview", "char_length", "word_length", "redaction_count"
            ),
            "event_id",
        )
        .join(tables.classifications.select("event_id", "category", "confidence"),
              "event_id", "left")
        .join(replies, "event_id", "left")
        .join(technologies, "event_id", "left")
        .join(contexts, "event_id", "left")
        .select(
            "event_id", "ts_ms", "provider_id", "model", "project_id", "session_id", "category",
            F.col("confidence").alias("category_confidence"), "text",
            F.col("text").isNotNull().alias("text_available"), "preview", "char_length",
            "word_length", "redaction_count", "response_text",
            F.coalesce("technologies", nothing).alias("technologies"),
            F.coalesce("contexts", nothing).alias("contexts"),
            "repository", "git_branch", "working_directory", "source_version",
            "estimated_cost_usd", "cache_read_tokens", "cache_write_tokens",
        )
    )


def repeated(tables: Tables, f: EventFilters | None = None, limit: int | None = None) -> DataFrame:
    """Prompts asked more than once, by fingerprint."""
    tables = prune(tables, f)
    prompts = apply_filters(tables, f, event_type="prompt").select("event_id", "ts_ms")
    grouped = (
        prompts.join(
            tables.prompts.where(F.col("char_length") > MIN_REPEAT_LENGTH).select(
                "event_id", "normalized_hash", "preview"
            ),
            "event_id",
        )
        .groupBy(F.col("normalized_hash").alias("fingerprint"))
        .agg(
            F.max("preview").alias("text"),
            F.count(F.lit(1)).alias("count"),
            F.max("ts_ms").alias("last_seen_ms"),
        )
        .where(F.col("count") > 1)
    )
    ordered = grouped.orderBy(F.desc("count"), F.desc("last_seen_ms"), "fingerprint")
    return ordered.limit(limit) if limit else ordered


def length_stats(tables: Tables, f: EventFilters | None = None) -> DataFrame:
    tables = prune(tables, f)
    prompts = apply_filters(tables, f, event_type="prompt").select("event_id")
    return prompts.join(
        tables.prompts.select("event_id", "char_length", "word_length"), "event_id"
    ).agg(
        F.coalesce(F.avg("char_length"), F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.avg("word_length"), F.lit(0.0)).alias("avg_words"),
        F.count(F.lit(1)).alias("total"),
    )


def stored_texts(tables: Tables, f: EventFilters | None = None) -> DataFrame:
    """The stored text of every prompt in scope, redacted as it was stored."""
    tables = prune(tables, f)
    prompts = apply_filters(tables, f, event_type="prompt").select("event_id")
    return prompts.join(
        tables.prompts.where(F.col("text").isNotNull()).select("event_id", "text"), "event_id"
    )


def themes(texts: DataFrame, limit: int | None = 12) -> DataFrame:
    """The terms that occur in most texts, ties alphabetically; the number of terms is the feature."""
    tokens = F.array_except(
        F.split(tx.normalized_text(F.col("text")), " "), F.array(*[F.lit(w) for w in STOP_WORDS])
    )
    counted = (
        texts.select(F.explode(tokens).alias("term"))
        .where(F.length("term") >= 4)
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "term")
    )
    return counted if limit is None else counted.limit(limit)
