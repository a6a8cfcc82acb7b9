"""Versioned enrichment of prompts: intent, technologies and task areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.contract import ENRICHMENT_VERSION, Tables
from usagelake.functions import classify as cl
from usagelake.functions.exprs import once
from usagelake.functions.text import normalized_text
from usagelake.operators.asof import following_tools

#: Every side row carries its event's day and provider, the partition keys of the store.
KEYS = ("event_id", "local_date", "provider_id")

#: ``(text, tool names) -> struct<category,confidence,version>``; a pandas UDF fits as well.
Classifier = Callable[[Column, Column], Column]


def due_events(events: DataFrame, version: int = ENRICHMENT_VERSION) -> DataFrame:
    """Prompts below the current version."""
    return events.where((F.col("event_type") == "prompt") & (F.col("enrichment_version") < version))


def pending(tables: Tables, version: int = ENRICHMENT_VERSION) -> DataFrame:
    """Prompts below the current version with their text and the tools that ran right after."""
    due = due_events(tables.events, version)
    # Tool calls matter only in sessions that have a prompt to enrich.
    sessions = due.where(F.col("session_id").isNotNull()).select("session_id").distinct()
    around = tables.events.join(sessions, "session_id", "left_semi")
    tools = following_tools(around, tables.tool_calls)
    return (
        due.select("event_id", "project_id", "session_id", "ts_ms", "local_date", "provider_id")
        .join(tables.prompts.select("event_id", "text"), "event_id", "left")
        .join(tools, "event_id", "left")
        .withColumn(
            "tool_names", F.coalesce("tool_names", F.array().cast("array<string>"))
        )
    )


def pending_count(events: DataFrame, version: int = ENRICHMENT_VERSION) -> DataFrame:
    return due_events(events, version).agg(F.count(F.lit(1)).alias("pending"))


def annotate(
    rows: DataFrame, classifier: Classifier = cl.classify, profiles: DataFrame | None = None,
    label_only: bool = False,
) -> DataFrame:
    """Add classification, technologies and contexts to ``rows(text, tool_names, …)``.

    ``profiles(project_id, technologies)`` is what manifests revealed about each project. For
    readers of the classification alone, ``label_only`` leaves the others out: the optimizer can't.
    """
    if profiles is None:
        rows = rows.withColumn("profile", F.array().cast("array<string>"))
    else:
        known = profiles.select("project_id", F.col("technologies").alias("profile"))
        rows = rows.join(known, "project_id", "left")
    text = F.coalesce("text", F.lit(""))
    # One pass over the text finds the terms all three detectors ask about.
    named = once(rows, "normalized", normalized_text(text))
    hit = once(named, "hits", cl.term_hits(F.col("normalized")))
    placed = hit
    if not label_only:
        found = once(
            hit, "technologies",
            cl.detect_technologies(text, F.col("profile"), hits=F.col("hits")),
        )
        placed = once(
            found, "contexts",
            cl.detect_contexts(F.col("normalized"), F.col("technologies"), F.col("hits")),
        )
    if classifier is cl.classify:
        label = cl.classify_normalized(
            F.col("normalized"), F.col("tool_names"), F.col("hits")
        )
    else:
        label = classifier(text, F.col("tool_names"))
    return once(placed, "classification", label).drop("profile", "normalized", "hits")


def classification_rows(annotated: DataFrame) -> DataFrame:
    return annotated.select(
        *KEYS,
        F.col("classification.category").alias("category"),
        F.col("classification.confidence").alias("confidence"),
        F.lit("heuristic").alias("source"),
        F.col("classification.version").alias("classifier_version"),
    )


def technology_rows(annotated: DataFrame) -> DataFrame:
    return annotated.select(*KEYS, F.explode("technologies").alias("t")).select(
        *KEYS, F.col("t.name").alias("technology"), F.col("t.confidence").alias("confidence"),
        F.lit("heuristic").alias("source"),
    )


def context_rows(annotated: DataFrame) -> DataFrame:
    return annotated.select(*KEYS, F.explode("contexts").alias("c")).select(
        *KEYS, F.col("c.name").alias("context"), F.col("c.confidence").alias("confidence")
    )


def apply_enrichment(
    tables: Tables, annotated: DataFrame, version: int = ENRICHMENT_VERSION,
    done: DataFrame | None = None, labels: DataFrame | None = None,
) -> Tables:
    """Tables after storing an enrichment pass; a person's own category survives it.

    Where ``annotated`` is not stored, every read of it does its work anew: ``done`` then has its
    event ids and ``labels`` its rows with the classification alone.
    """
    done = annotated.select("event_id") if done is None else done
    labels = annotated if labels is None else labels
    by_user = tables.classifications.where(F.col("source") == "user").select("event_id")
    fresh = classification_rows(labels).join(by_user, "event_id", "left_anti")
    replaced = done.join(by_user, "event_id", "left_anti")
    kept = tables.classifications.join(replaced, "event_id", "left_anti")
    classifications = kept.unionByName(fresh)

    heuristic = F.col("source") == "heuristic"
    others = tables.technologies.where(~heuristic).unionByName(
        tables.technologies.where(heuristic).join(done, "event_id", "left_anti")
    )
    fresh_tech = technology_rows(annotated)
    technologies = others.join(
        fresh_tech.select("event_id", "technology"), ["event_id", "technology"], "left_anti"
    ).unionByName(fresh_tech)

    contexts = tables.contexts.join(done, "event_id", "left_anti").unionByName(
        context_rows(annotated)
    )
    marked = tables.events.join(done.withColumn("done", F.lit(True)), "event_id", "left")
    events = marked.withColumn(
        "enrichment_version",
        F.when(F.col("done"), F.lit(version)).otherwise(F.col("enrichment_version")),
    ).select(*tables.events.columns)
    return tables.but(
        events=events, classifications=classifications, technologies=technologies,
        contexts=contexts,
    )


def enrich(
    tables: Tables, version: int = ENRICHMENT_VERSION, classifier: Classifier = cl.classify,
    profiles: DataFrame | None = None,
) -> tuple[Tables, DataFrame]:
    """One pass over everything pending, and the (day, provider) pairs it touched."""
    rows = pending(tables, version)
    due = due_events(tables.events, version)
    after = apply_enrichment(
        tables, annotate(rows, classifier, profiles), version, due.select("event_id"),
        annotate(rows, classifier, profiles, label_only=True),
    )
    return after, due.select("local_date", "provider_id").distinct()


def reset_versions(events: DataFrame) -> DataFrame:
    """Mark every event for reprocessing."""
    return events.withColumn("enrichment_version", F.lit(0))


def apply_overrides(tables: Tables, overrides: DataFrame) -> Tables:
    """``overrides(event_id, category, contexts array, classifier_version)`` from the person.

    The category is certain from then on; task areas are replaced when the person named any.
    """
    overrides = overrides.join(tables.events.select(*KEYS), "event_id")
    chosen = overrides.select(
        *KEYS, "category", F.lit(1.0).alias("confidence"), F.lit("user").alias("source"),
        "classifier_version",
    )
    classifications = tables.classifications.join(
        chosen.select("event_id"), "event_id", "left_anti"
    ).unionByName(chosen)
    named = overrides.where(F.size("contexts") > 0)
    contexts = tables.contexts.join(
        named.select("event_id"), "event_id", "left_anti"
    ).unionByName(
        named.select(*KEYS, F.explode("contexts").alias("context")).withColumn(
            "confidence", F.lit(1.0)
        )
    )
    return tables.but(classifications=classifications, contexts=contexts)


def confusion(labelled: DataFrame, classifier: Classifier = cl.classify) -> DataFrame:
    """``labelled(text, expected[, tool_names])`` as expected/predicted counts."""
    tools = F.col("tool_names") if "tool_names" in labelled.columns else F.array()
    predicted = classifier(F.col("text"), tools.cast("array<string>"))["category"]
    return (
        labelled.withColumn("predicted", predicted)
        .groupBy("expected", "predicted")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def accuracy(labelled: DataFrame, classifier: Classifier = cl.classify) -> DataFrame:
    right = F.sum(F.when(F.col("expected") == F.col("predicted"), F.col("count")).otherwise(0))
    return confusion(labelled, classifier).agg(
        F.sum("count").alias("prompts"), (right / F.sum("count")).alias("accuracy")
    )
