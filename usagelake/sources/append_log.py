"""Batches beside the stored log: added files, merge on read, and compaction as a job of its own.

A batch is a folder of small sets and one commit file, written last: readers see all of a batch or
nothing of it, and publishing it rewrites nothing. ``added`` rows have keys that were never stored,
so reading them is a union; ``patches`` are later copies, folded on read only into the rows that
they hit. Compaction writes the days that batches touched once more, merged, and takes the batches
away. Its record is the moment of change: from then on readers take the touched days from what was
staged, until those are published; whoever finds the record after a crash finishes the work.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelake.operators.merge import merge_events

#: Sets that batches add to, and the key their patches name.
LOGGED = {"events": "dedupe_key", "prompts": "event_id", "responses": "event_id", "tool_calls": "event_id",
          "terms": "event_id"}
#: Sets of what waits for its other side, by the key that settles it: prompts for a reply, tool calls
#: for an outcome, outcomes for their call.
OPEN = {"waiting": "dedupe_key", "calls": "event_id", "outcomes": "outcome_key"}
DAYS = ["local_date", "provider_id"]


class AppendLog:
    """The batches of an ``EventStore`` that are not compacted yet."""

    def __init__(self, store):
        self.store = store
        self.spark = store.spark
        self.root = f"{store.root}/_log"

    # -- batches ------------------------------------------------------------------------------

    def commits(self) -> list[str]:
        """Published batches that no compaction has consumed, in the order they came."""
        consumed = {n for r in self._records().values() for n in r["batches"]}
        return [n for n in self.store.names(f"{self.root}/commits") if n not in consumed]

    def holds(self, batch: str) -> bool:
        """Whether a batch of this name, source and content is published and not yet compacted."""
        return any(n.split(".", 1)[1] == batch for n in self.commits())

    def _name(self, batch: str) -> str:
        """The folder of a batch; the same one when the batch is run again."""
        begun = self.store.names(f"{self.root}/batches")
        for name in begun:
            if name.split(".", 1)[1] == batch:
                return name
        last = [int(n.split(".", 1)[0]) for n in [*begun, *self.store.names(f"{self.root}/commits"), *self._consumed()]]
        return f"{max(last, default=-1) + 1:012d}.{batch}"

    def _consumed(self) -> list[str]:
        mark = f"{self.root}/last"
        found = [json.loads(self.store.read_text(mark))["name"]] if self.store.exists(mark) else []
        return found + [n for r in self._records().values() for n in r["batches"]]

    def add(self, batch: str, sets: dict[str, DataFrame]) -> None:
        """Publish a batch: ``events.added``, ``events.patches``, ``prompts.added`` and so on.

        Its frames must be derived from what was staged. Running it again after a failure writes
        the same folder again; empty sets are left out.
        """
        name = self._name(batch)
        if self.store.exists(f"{self.root}/commits/{name}"):
            return
        schemas = {}
        for part, df in sets.items():
            path = f"{self.root}/batches/{name}/{part}"
            if not self.store.finished(path):
                # Unpartitioned, so nothing of a batch is told by folders; postings keep their order.
                rows = self.store.arranged(part.partition(".")[0], df.hint("rebalance"), folders=False)
                rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
            if not self.spark.read.schema(df.schema).parquet(path).isEmpty():
                schemas[part] = df.schema.json()
        self.store.write_text(f"{self.root}/commits/{name}", json.dumps(schemas))

    def part(self, part: str, names: list[str] | None = None) -> DataFrame | None:
        """Rows of one set of all batches, with ``_batch``, the batch's place in their order."""
        found = None
        for at, name in enumerate(self.commits() if names is None else names):
            schemas = json.loads(self.store.read_text(f"{self.root}/commits/{name}"))
            if part in schemas:
                schema = T.StructType.fromJson(json.loads(schemas[part]))
                df = self.spark.read.schema(schema).parquet(f"{self.root}/batches/{name}/{part}")
                df = df.withColumn("_batch", F.lit(int(name.split(".", 1)[0])).cast("long"))
                found = df if found is None else found.unionByName(df, allowMissingColumns=True)
        return found

    # -- reading ------------------------------------------------------------------------------

    def read(self, dataset: str) -> DataFrame | None:
        """The stored rows and those of all batches, merged."""
        rows = self._base(dataset)
        added = self.part(f"{dataset}.added")
        if added is not None:
            added = added.drop("_batch")
            rows = added if rows is None else rows.unionByName(added.select(*rows.columns))
        patches = self.part(f"{dataset}.patches")
        if patches is None or rows is None:
            return rows
        key = LOGGED[dataset]
        named = patches.select(key).distinct()
        hit = rows.join(named, key, "left_semi")
        rest = rows.join(named, key, "left_anti").select(*rows.columns)
        return rest.unionByName(_patched(dataset, hit.select(*rows.columns), patches).select(*rows.columns))

    def _base(self, dataset: str) -> DataFrame | None:
        """The stored rows, with the touched days of an unfinished compaction from its staging."""
        rows = self.store.stored(dataset)
        for label, record in self._records().items():
            if not record.get("published") and dataset in record["schemas"]:
                staged = self._staged(label, record, dataset)
                if rows is not None:
                    touched = self._staged(label, record, "touched")
                    rows = rows.join(touched, DAYS, "left_anti").select(*staged.columns)
                rows = staged if rows is None else rows.unionByName(staged)
        return rows

    def _staged(self, label: str, record: dict, dataset: str) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(record["schemas"][dataset]))
        return self.spark.read.schema(schema).parquet(f"{self.store.root}/_staging/{label}/{dataset}")

    # -- compaction ---------------------------------------------------------------------------

    def _records(self) -> dict[str, dict]:
        names = self.store.names(f"{self.root}/compactions")
        records = {n: json.loads(self.store.read_text(f"{self.root}/compactions/{n}")) for n in names
                   if not n.endswith(".published")}
        for n in records:
            records[n]["published"] = f"{n}.published" in names
        return records

    def compact(self) -> None:
        """Merge all batches into the stored log; only days that they touched are written."""
        self.recover()
        names = self.commits()
        if not names:
            return
        label = f"compact-{names[-1]}"
        days = []
        for dataset, key in LOGGED.items():
            added, patches = self.part(f"{dataset}.added", names), self.part(f"{dataset}.patches", names)
            if added is not None:
                days.append(added.select(*DAYS))
            if patches is not None:
                days += [self.read(dataset).join(patches.select(key).distinct(), key, "left_semi").select(*DAYS)]
        schemas = {}
        if days:
            touched = days[0]
            for more in days[1:]:
                touched = touched.unionByName(more)
            touched = self.store.stage(label, "touched", touched.distinct())
            schemas["touched"] = touched.schema.json()
            for dataset in LOGGED:
                rows = self.read(dataset)
                if rows is not None:
                    part = rows.join(touched, DAYS, "left_semi").select(*rows.columns)
                    schemas[dataset] = self.store.stage(label, dataset, part).schema.json()
        for part in ["keys", *[f"{name}.{side}" for name in OPEN for side in ("added", "settled")]]:
            rows = self.part(part, names)
            if rows is not None:
                schemas[part] = self.store.stage(label, part, rows.drop("_batch")).schema.json()
        record = {"batches": names, "schemas": schemas}
        self.store.write_text(f"{self.root}/compactions/{label}", json.dumps(record))
        self.recover()

    def recover(self) -> None:
        """Finish a compaction whose record stands: publish what it staged, drop what it consumed."""
        for label, record in self._records().items():
            if not record["published"]:
                for dataset in LOGGED:
                    if dataset in record["schemas"]:
                        self.store.write(dataset, self._staged(label, record, dataset))
                if "keys" in record["schemas"]:
                    self.store.keys_index.add(label, self._staged(label, record, "keys"))
                for name in OPEN:
                    rows = self._open(name, label, record)
                    if rows is not None:
                        self.store.write(name, rows)
                self.store.write_text(f"{self.root}/compactions/{label}.published", "{}")
            self.store.write_text(f"{self.root}/last", json.dumps({"name": record["batches"][-1]}))
            for name in record["batches"]:
                self.store.remove(f"{self.root}/commits/{name}")
                self.store.remove(f"{self.root}/batches/{name}")
            self.store.remove(f"{self.root}/compactions/{label}")
            self.store.remove(f"{self.root}/compactions/{label}.published")
            self.store.unstage(label)

    # -- what waits for its other side --------------------------------------------------------

    def waiting(self, name: str) -> DataFrame | None:
        """Rows of an open set that nothing has settled."""
        rows = self.store.stored(name)
        for label, record in self._records().items():
            if not record["published"]:
                rows = self._open(name, label, record)
        return _unsettled(rows, self.part(f"{name}.added"), self.part(f"{name}.settled"), OPEN[name])

    def _open(self, name: str, label: str, record: dict) -> DataFrame | None:
        """The set after a compaction; the same whether it was written already or not."""
        added, settled = (
            self._staged(label, record, f"{name}.{side}") if f"{name}.{side}" in record["schemas"] else None
            for side in ("added", "settled"))
        return _unsettled(self.store.stored(name), added, settled, OPEN[name])


def _unsettled(rows: DataFrame | None, added: DataFrame | None, settled: DataFrame | None,
               key: str) -> DataFrame | None:
    if added is not None:
        added = added.drop("_batch")
        rows = added if rows is None else rows.unionByName(added)
        rows = rows.dropDuplicates([key])
    if rows is not None and settled is not None:
        rows = rows.join(settled.select(key).distinct(), key, "left_anti").select(*rows.columns)
    return rows


def _patched(dataset: str, hit: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows with later copies folded in; of a tool call, the outcome that came last."""
    if dataset == "events":
        return merge_events(hit, patches, F.struct("_batch", "ts_ms"))
    latest = patches.groupBy("event_id").agg(F.max_by("succeeded", F.struct("_batch", "at")).alias("_outcome"))
    return hit.join(latest, "event_id", "left").withColumn(
        "succeeded", F.coalesce("_outcome", "succeeded")).drop("_outcome")


def batch_label(text: str) -> str:
    """A batch name that can be a folder."""
    return re.sub(r"[^A-Za-z0-9_\-]", "_", text)
