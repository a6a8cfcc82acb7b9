"""Ingest of micro-batches into the store: one path for backfill, follow mode and push.

Delivery is at least once; the effect is exactly once because events merge on their dedupe key,
every step of a batch is staged before anything is published, a batch that is run again after a
failure publishes the same staged frames, and its files count from its commit on. Staging is named
by source, batch and content, so batches of another stream or of a new checkpoint never meet it,
and is dropped when the batch is published.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelake.contract import ENRICHMENT_VERSION, Settings, Tables
from usagelake.functions import classify as cl
from usagelake.operators import asof, enrichment, maintenance as mt, merge, normalize as nz, rollups as ru
from usagelake.operators.prompts import term_rows
from usagelake.operators.sessions import session_metrics
from usagelake.session import spread
from usagelake.sources import transcript_source as source, transcripts as tr
from usagelake.sources.append_log import OPEN, batch_label
from usagelake.sources.store import ROLLUPS, EventStore

DAYS = ["local_date", "provider_id"]
SIDES = (("prompts", "prompt"), ("responses", "response"), ("tool_calls", "tool_call"))
#: What is kept of a prompt that waits, and what attribution looks at.
PROMPT = ("dedupe_key", "event_id", "session_id", "is_subagent", "ts_ms", *DAYS)
LINK = (*PROMPT, "event_type", "model", "model_family")


class Ingest:
    """Applies batches of source events to a store and keeps its derived tables fresh."""

    def __init__(self, store: EventStore, settings: Settings | None = None,
                 source: str = "push", provider_id: str | None = None,
                 defer_rollups: bool = False):
        self.store = store
        self.settings = settings or Settings()
        self.source = source
        self.provider_id = provider_id
        self.defer_rollups = defer_rollups

    # -- one batch ----------------------------------------------------------------------------

    def run(self, events: DataFrame, batch_id: int | str, outcomes: DataFrame | None = None) -> None:
        """Validate, normalise, merge, attribute, roll up and audit one batch.

        The signature is the one ``foreachBatch`` calls. ``outcomes`` (provider_id, external_id,
        succeeded, at) are answers to tool calls, which may have come in an earlier batch or come in
        a later one. A batch adds files beside the log and asks the index of keys, once, which of
        its events are stored; nothing stored is read or written as a whole.
        """
        store, started = self.store, dt.datetime.now(dt.timezone.utc)
        store.log.recover()
        conformed = nz.conform(events, self.provider_id)
        name = batch_label(f"{self.source}-{batch_id}-{_content(conformed)}")
        if store.log.holds(name):
            return
        self._begin()
        checked = store.stage(name, "checked", nz.validate(conformed))
        valid = checked.where("is_valid")
        providers = store.read("providers")
        accepted = spread(valid if providers is None else nz.drop_paused(valid, providers))
        normalized = store.stage(name, "normalized", nz.normalize(accepted, self.settings))

        once = store.stage(name, "once", merge.merge_events(None, normalized))
        known = store.keys_index.known(name, once.select("dedupe_key"))
        fresh = store.stage(name, "fresh", once.join(known, "dedupe_key", "left_anti").select(*once.columns))
        later = once.join(known.select("dedupe_key"), "dedupe_key", "left_semi").select(*once.columns)
        linked = self._attribute(name, once, fresh)
        answered = self._answer(name, fresh, outcomes)
        # A later copy may carry another clock than the stored one, so its day is touched too.
        touched = store.stage(name, "touched", merge.union_touched(
            merge.touched_days(normalized), known.select(*DAYS), linked.select(*DAYS), answered.select(*DAYS)))

        sides = nz.stored_tables(fresh)
        new = sides.events.join(
            linked.select("dedupe_key", "new_model", "new_family"), "dedupe_key", "left"
        ).withColumn("model", F.coalesce("model", "new_model")).withColumn(
            "model_family", F.coalesce("model_family", "new_family")).select(*sides.events.columns)
        old = linked.join(fresh.select("dedupe_key"), "dedupe_key", "left_anti")
        waits = _open_prompts(fresh).join(linked.select("dedupe_key"), "dedupe_key", "left_anti")
        store.log.add(name, {
            "events.added": new,
            "events.patches": nz.stored_tables(later).events.unionByName(_model_patches(old, sides.events)),
            **{f"{dataset}.added": getattr(sides, dataset) for dataset, _ in SIDES},
            "terms.added": term_rows(sides.prompts),
            "tool_calls.patches": answered,
            "keys": fresh.select("dedupe_key", *DAYS),
            "waiting.added": waits.select(*PROMPT), "waiting.settled": linked.select("dedupe_key"),
            **{f"{n}.{side}": df for n, pair in self._open_calls(fresh, answered, outcomes).items()
               for side, df in zip(("added", "settled"), pair) if df is not None},
        })
        self._dimensions(name, normalized)
        sessions = store.stage(
            name, "sessions",
            normalized.select("session_id").where(F.col("session_id").isNotNull()).distinct(),
        )
        if not self.defer_rollups:
            self.refresh(touched, sessions, name)
        self._audit(name, f"{self.source}-{batch_id}", checked, normalized, fresh, started)
        store.unstage(name)

    def run_lines(self, lines: DataFrame, batch_id: int | str) -> None:
        """One batch of transcript lines, whose answers may belong to calls of other batches."""
        label = batch_label(f"lines-{self.source}-{batch_id}-{_content(lines)}")
        # Every step of a batch asks for these, and reading a record costs far more than its row.
        parsed = tr.parse(spread(self.store.stage(label, "lines", lines)))
        events = self.store.stage(label, "mapped", tr.map_records(parsed, self.settings.store_responses))
        outcomes = self.store.stage(label, "answers", tr.tool_outcomes(parsed).select(
            F.lit(tr.PROVIDER_ID).alias("provider_id"), "external_id", F.col("outcome").alias("succeeded"), "at"))
        self.run(events, batch_id, outcomes)
        self.store.unstage(label)

    def compact(self) -> None:
        """Merge the batches that lie beside the log into it."""
        self.store.log.compact()

    def _begin(self) -> None:
        """Index the keys of a store that was filled without batches, and find what waits in it."""
        store = self.store
        if store.keys_index.generations() or store.log.commits():
            return
        stored = store.stored("events")
        if stored is not None:
            store.keys_index.add("begin", stored.select("dedupe_key", *DAYS))
            store.write("waiting", _open_prompts(stored).select(*PROMPT))
            texts = store.stored("prompts")
            if texts is not None:
                store.write("terms", term_rows(texts))

    def _attribute(self, batch: str, once: DataFrame, fresh: DataFrame) -> DataFrame:
        """Prompts, waiting or of this batch, with the model of a reply that was found for them.

        Replies are those of the batch and, for its new prompts only, stored ones of the same
        sessions, from two days before the earliest prompt on, as clocks of one session may differ.
        """
        store = self.store
        prompts = _open_prompts(fresh)
        waiting = store.log.waiting("waiting")
        replies = once.where((F.col("event_type") == "response") & F.col("model").isNotNull())
        here = replies.select(*LINK)
        if waiting is not None:
            asked = waiting.join(replies.select("session_id").distinct(), "session_id", "left_semi")
            prompts = prompts.select(*PROMPT).unionByName(asked.select(*PROMPT)).dropDuplicates(["dedupe_key"])
        first = _open_prompts(fresh).agg(F.min("local_date")).first()[0]
        stored = store.read("events") if first else None
        if stored is not None:
            before = stored.where(
                (F.col("local_date") >= F.lit(first) - F.expr("INTERVAL 2 DAYS")) & (F.col("event_type") == "response")
                & F.col("model").isNotNull()
            ).join(_open_prompts(fresh).select("session_id").distinct(), "session_id", "left_semi")
            here = here.unionByName(before.select(*LINK)).dropDuplicates(["dedupe_key"])
        asked = prompts.select(*PROMPT).withColumns({
            "event_type": F.lit("prompt"), "model": F.lit(None).cast("string"),
            "model_family": F.lit(None).cast("string")}).select(*LINK)
        found = asof.link_prompt_models(asked.unionByName(here)).where("linked").select(
            "dedupe_key", *DAYS, F.col("model").alias("new_model"), F.col("model_family").alias("new_family"))
        return store.stage(batch, "linked", found)

    def _answer(self, batch: str, fresh: DataFrame, outcomes: DataFrame | None) -> DataFrame:
        """Outcomes of tool calls, both sides of any batch: event_id, day, succeeded, at, outcome_key."""
        store = self.store
        empty = store.spark.createDataFrame(
            [], "event_id string, local_date date, provider_id string, succeeded boolean, at string, outcome_key string")
        answers, calls = store.log.waiting("outcomes"), _calls(fresh)
        if outcomes is not None:
            now = _outcomes(outcomes)
            answers = now if answers is None else answers.unionByName(now.select(*answers.columns))
        if answers is None:
            return empty
        standing = store.log.waiting("calls")
        if standing is not None:
            calls = calls.unionByName(standing.select(*calls.columns)).dropDuplicates(["event_id"])
        latest = answers.groupBy("outcome_key").agg(
            F.max(F.struct("at", "succeeded")).alias("a")).select("outcome_key", "a.*")
        return store.stage(batch, "answered", calls.join(latest, "outcome_key").select(*empty.columns))

    def _open_calls(self, fresh: DataFrame, answered: DataFrame, outcomes: DataFrame | None) -> dict:
        """Calls and outcomes that this batch leaves open, and those that it settles."""
        settled = answered.select("event_id"), answered.select("outcome_key")
        calls = _calls(fresh).join(settled[0], "event_id", "left_anti")
        left = None if outcomes is None else _outcomes(outcomes).join(settled[1].distinct(), "outcome_key", "left_anti")
        return {"calls": (calls, settled[0]), "outcomes": (left, settled[1])}

    def _dimensions(self, batch: str, normalized: DataFrame) -> None:
        from usagelake.operators.projects import merge_projects
        from usagelake.operators.totals import touch_last_event

        store = self.store
        seen = nz.project_rows(normalized)
        projects = store.read("projects")
        rows = seen if projects is None else merge_projects(projects, seen)
        store.write("projects", store.stage(batch, "projects", rows))

        empty = store.spark.createDataFrame(
            [], "provider_id string, name string, enabled boolean, last_event_ms bigint"
        )
        known = store.read("providers")
        known = empty if known is None else known
        new = nz.register_providers(normalized, known).withColumn(
            "last_event_ms", F.lit(None).cast("bigint")
        )
        rows = touch_last_event(known.unionByName(new), normalized)
        store.write("providers", store.stage(batch, "providers", rows.select(*empty.columns)))

    # -- derived tables -----------------------------------------------------------------------

    def refresh(self, touched: DataFrame, sessions: DataFrame | None, batch: str) -> None:
        """Rebuild the rollups of the touched (day, provider) pairs.

        A new event also shortens the gap before the next event of its session, which may lie on a
        later day, so active time is rebuilt for the later days of those sessions as well.
        """
        store, t = self.store, self.store.tables()
        rolled = ru.daily_rollups(t, touched).withColumn("settings", F.lit(self.settings.rollup_fingerprint()))
        store.replace("daily_rollups", store.stage(batch, "daily_rollups", rolled), touched)
        stale = touched
        if sessions is not None:
            first = touched.agg(F.min("local_date")).scalar()
            later = t.events.join(sessions, "session_id", "left_semi").where(
                F.col("local_date") >= first
            )
            stale = merge.union_touched(touched, later.select(*DAYS))
        active = ru.daily_active(t.events, stale, self.settings.idle_ms, self.settings.tail_ms)
        store.replace("daily_active", store.stage(batch, "daily_active", active), stale)

    def rebuild(self) -> None:
        """Rebuild all rollups, after an import with deferred rollups or a changed idle limit."""
        label = _label("rebuild")
        self.refresh(self.store.tables().events.select(*DAYS).distinct(), None, label)
        self.store.unstage(label)

    def rebuild_stale(self) -> int:
        """Rebuild the days whose rollups are missing or were built under other settings; how many."""
        label = _label("stale")
        events = self.store.read("events")
        if events is None:
            return 0
        fingerprint = self.settings.rollup_fingerprint()
        stale = self.store.stage(label, "days", ru.stale_days(events, self.store.read("daily_rollups"), fingerprint))
        n = stale.count()
        if n:
            self.refresh(stale, None, label)
        self.store.unstage(label)
        return n

    # -- maintenance --------------------------------------------------------------------------

    def delete(self, scope: mt.DeleteScope) -> None:
        """Delete from the store what the scope covers, and rebuild the rollups of its days."""
        self.store.log.compact()
        t = self.store.tables()
        touched = t.events.select(*DAYS).distinct() if scope.scope in ("all", "prompts") else (
            mt.touched_by(t, scope))
        self._apply(mt.delete(t, scope), touched)

    def retain(self, as_of: dt.datetime | None = None) -> None:
        """Clear the stored text of prompts older than the retention of the settings."""
        self.store.log.compact()
        months, as_of = self.settings.retention_months, as_of or self.settings.as_of
        t = self.store.tables()
        old = t.events.where(F.col("ts_ms") < mt.retention_cutoff_ms(as_of, months))
        if months > 0:
            self._apply(mt.apply_retention(t, months, as_of), old.select(*DAYS).distinct())

    def _apply(self, after: Tables, touched: DataFrame) -> None:
        """Publish changed tables: the touched days of every set, then their rollups."""
        store, label = self.store, _label("apply")
        touched = store.stage(label, "touched", touched)
        staged = {}
        for f in fields(Tables):
            df = getattr(after, f.name)
            if df is not None:
                part = df.join(touched, DAYS, "left_semi").select(*df.columns) if "local_date" in df.columns else df
                staged[f.name] = store.stage(label, f.name, part)
        if "prompts" in staged:
            staged["terms"] = store.stage(label, "terms", term_rows(staged["prompts"]))
        for name, df in staged.items():
            store.replace(name, df, touched)
        left = store.read("events")
        store.keys_index.rebuild(label, None if left is None else left.select("dedupe_key", *DAYS))
        if left is None:
            for name in (*ROLLUPS, *OPEN):
                store.remove(store.path(name))
            store.unstage(label)
            return
        # Active time of later days counted the gap after an event that may be gone.
        first = touched.agg(F.min("local_date")).scalar()
        later = store.tables().events.where(F.col("local_date") >= first).select(*DAYS)
        self.refresh(store.stage(label, "stale", merge.union_touched(touched, later)), None, label)
        store.unstage(label)

    def enrich(self, version: int = ENRICHMENT_VERSION,
               classifier: enrichment.Classifier = cl.classify,
               profiles: DataFrame | None = None) -> None:
        """Classify everything pending and rebuild what that touched."""
        self.store.log.compact()
        store, t, label = self.store, self.store.tables(), _label("enrich")
        rows = store.stage(
            label, "annotated", enrichment.annotate(enrichment.pending(t, version), classifier,
                                                    profiles)
        )
        days = store.stage(label, "days", rows.select(*DAYS).distinct())
        after = enrichment.apply_enrichment(t, rows, version)
        staged = {}
        for name in ("classifications", "technologies", "contexts", "events"):
            frame = getattr(after, name).join(days, DAYS, "left_semi")
            staged[name] = store.stage(label, name, frame.select(*getattr(after, name).columns))
        for name, df in staged.items():
            store.replace(name, df, days)
        self.refresh(days, None, label)
        store.unstage(label)

    def sessions(self) -> DataFrame:
        """Session rows, always derived from the events they summarise."""
        return session_metrics(
            self.store.read("events"), self.settings.idle_ms, self.settings.tail_ms
        )

    def _audit(self, batch: str, shown: str, checked: DataFrame, normalized: DataFrame,
               fresh: DataFrame, started: dt.datetime) -> None:
        """One entry per batch; content that comes again under the same id keeps its first entry."""
        entry = f"{self.store.path('ingest_log')}/batch={batch}"
        if self.store.finished(entry):
            return
        valid = F.count(F.when(F.col("is_valid"), 1))
        kept, new = (df.agg(F.count(F.lit(1))).scalar() for df in (normalized, fresh))
        row = checked.agg(
            (F.count(F.lit(1)) - valid).alias("failed"), valid.alias("valid")
        ).select(
            F.lit(shown).alias("batch_id"), F.lit(self.source).alias("source"),
            new.alias("accepted"), (kept - new).alias("deduped"),
            "failed", (F.col("valid") - kept).alias("skipped"),
            F.lit(started.isoformat()).alias("started_at"),
        )
        row.coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).parquet(entry)

    def audit(self) -> DataFrame:
        return self.store.spark.read.parquet(self.store.path("ingest_log")).drop("batch")


def _open_prompts(events: DataFrame) -> DataFrame:
    return events.where((F.col("event_type") == "prompt") & F.col("model").isNull() & F.col("session_id").isNotNull())


def _model_patches(linked: DataFrame, events: DataFrame) -> DataFrame:
    """Found models as copies of the stored prompts that have nothing else to fill in."""
    known = {
        "dedupe_key": F.col("dedupe_key"), "model": F.col("new_model"), "model_family": F.col("new_family"),
        "ingest_version": F.lit(2**31 - 1), "local_date": F.col("local_date"), "provider_id": F.col("provider_id")}
    return linked.select(*[
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])


def _outcome_key(external_id: str = "external_id"):
    return F.sha2(F.concat_ws("|", "provider_id", external_id), 256).alias("outcome_key")


def _outcomes(outcomes: DataFrame) -> DataFrame:
    """The latest answer per call."""
    return outcomes.where("external_id IS NOT NULL").groupBy(_outcome_key()).agg(
        F.max(F.struct(F.coalesce("at", F.lit("")).alias("at"), "succeeded")).alias("a")).select("outcome_key", "a.*")


def _calls(fresh: DataFrame) -> DataFrame:
    """Tool calls without an outcome."""
    return fresh.where(
        F.col("tool_call").isNotNull() & F.col("tool_call.succeeded").isNull() & F.col("external_id").isNotNull()
    ).select("event_id", *DAYS, _outcome_key())


def _content(events: DataFrame) -> str:
    """A fingerprint of a batch's rows, whatever their order."""
    row = events.select(F.xxhash64(*events.columns).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")
    ).first()
    return f"{row['n']}-{(row['x'] or 0) & (2**64 - 1):016x}-{int(row['s'] or 0) & (2**64 - 1):016x}"


def _label(what: str) -> str:
    """A staging name of its own for every call."""
    return f"{what}-{uuid.uuid4().hex}"


def backfill(stream: DataFrame, ingest: Ingest, checkpoint: str, lines: bool = False) -> StreamingQuery:
    """Process everything that is there, in bounded batches, then stop; ``lines`` for transcripts."""
    return _start(stream, ingest.run_lines if lines else ingest.run, checkpoint).trigger(availableNow=True).start()


def follow(stream: DataFrame, ingest: Ingest, checkpoint: str,
           every: str = "5 seconds", lines: bool = False) -> StreamingQuery:
    """Keep processing what arrives; the same checkpoint continues a finished backfill."""
    return _start(stream, ingest.run_lines if lines else ingest.run, checkpoint).trigger(processingTime=every).start()


def transcripts(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Lines of growing transcript files, for ``backfill`` and ``follow``."""
    source.register(spark)
    return spark.readStream.format("transcripts").option("path", path).option("pattern", pattern).load()


def _start(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
