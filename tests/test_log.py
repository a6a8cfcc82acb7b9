"""The transcript source, the append log, the index of keys and answers that come late."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import at, event, log, source
from usagelake.contract import Settings
from usagelake.operators import asof, normalize as nz, prompts as pr, rollups as ru
from usagelake.operators.maintenance import DeleteScope
from usagelake.sources import key_index, transcript_source as ts, transcripts as tr
from usagelake.sources.append_log import OPEN
from usagelake.sources.store import EventStore
from usagelake.streaming import ingest as ig
from usagelake.streaming.ingest import Ingest, backfill


# -- transcript files ---------------------------------------------------------------------------


def read(files, start=None):
    """Lines since an offset, as (file, place, line), and the new offset."""
    end = files.offset()
    found = [
        tuple(r.values()) for part in files.ranges(start or {}, end) for batch in files.lines(part.ranges)
        for r in batch.select(["source_path", "at", "value"]).to_pylist()]
    return sorted((os.path.basename(p), a, v) for p, a, v in found), end


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("chunk", [1, 5, 1 << 20])
def test_every_line_is_read_once_whatever_the_parts(tmp_path, monkeypatch, split, chunk):
    monkeypatch.setattr(ts, "READ", chunk)
    rng = random.Random(split)
    want = []
    for n in range(4):
        lines = ["".join(rng.choices("ab é日", k=rng.choice((0, 1, 3, 40)))) for _ in range(30 * (n > 0))]
        body = "".join(f"{line}\n" for line in lines).encode()
        (tmp_path / f"{n}.jsonl").write_bytes(body + b"not ended"[:9 * (n % 2)])
        places = [len("".join(f"{x}\n" for x in lines[:i]).encode()) for i in range(len(lines))]
        want += [(f"{n}.jsonl", p, line) for p, line in zip(places, lines)]
    (tmp_path / "other.txt").write_text("no\n")
    found, _ = read(ts.Files(str(tmp_path), "*.jsonl", split))
    assert found == sorted(want)


def test_grown_shrunk_rewritten_and_lost_files(tmp_path):
    files = ts.Files(f"file://{tmp_path}", "*.jsonl", 1000)
    grown, shrunk, other = (tmp_path / f"{n}.jsonl" for n in ("grown", "shrunk", "other"))
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "d.jsonl").write_text("deep\n")
    grown.write_text("one\ntw")
    shrunk.write_text("a\nb\nc\n")
    other.write_text("x" * 5000 + "\nend\n")
    found, first = read(files)
    assert [f[0] for f in found] == ["d.jsonl", "grown.jsonl", "other.jsonl", "other.jsonl", *["shrunk.jsonl"] * 3]
    assert read(files, first)[0] == []
    grown.write_text("one\ntwo\nthree")
    shrunk.write_text("a\n")
    other.write_text("y" + "x" * 4999 + "\nend\nmore\n")
    # Another process goes on from the written offset.
    fresh = ts.Files(str(tmp_path), "*.jsonl", 1000)
    found, second = read(fresh, json.loads(json.dumps(first)))
    assert found == [("grown.jsonl", 4, "two"), ("other.jsonl", 0, "y" + "x" * 4999), ("other.jsonl", 5001, "end"),
                     ("other.jsonl", 5005, "more"), ("shrunk.jsonl", 0, "a")]
    os.utime(grown, (1, 1))
    grown.write_text("one\ntwo\nthree\n")
    shrunk.unlink()
    assert read(fresh, second)[0] == [("grown.jsonl", 8, "three")]
    assert read(ts.Files(str(tmp_path / "nothing"), "*", 10))[0] == []


def empty(spark):
    return spark.createDataFrame([], "event_id string, category string, confidence double, technology string")


# -- transcripts into the store -----------------------------------------------------------------


def line(kind, n, minutes, **fields):
    return json.dumps({"type": kind, "uuid": f"u{n}", "sessionId": "s", "timestamp": at(minutes), "cwd": "/w",
                       **fields}) + "\n"


def prompt(n, minutes):
    return line("user", n, minutes, message={"role": "user", "content": f"please fix number {n}"})


def reply(n, minutes, part=0):
    return line("assistant", f"{n}-{part}", minutes, message={
        "id": f"msg-{n}", "model": "claude-opus-4-8", "usage": {"input_tokens": 7, "output_tokens": 3},
        "content": [{"type": "tool_use", "id": f"call-{n}", "name": "Edit", "input": {}}]})


def answer(n, minutes, failed):
    return line("user", f"a{n}", minutes, message={"content": [
        {"type": "tool_result", "tool_use_id": f"call-{n}", "is_error": failed}]})


def stored(ingest):
    events = {(r.external_id, r.event_type, r.model, r.input_tokens) for r in ingest.store.read("events").collect()}
    calls = {(r.tool_name, r.succeeded, r.event_id) for r in ingest.store.read("tool_calls").collect()}
    return events, calls


def test_following_files_gives_the_log_of_one_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    one, two = folder / "one.jsonl", folder / "two.jsonl"
    ingest = Ingest(EventStore(spark, str(tmp_path / "a")), Settings(), defer_rollups=True)

    def step():
        backfill(ig.transcripts(spark, str(folder)), ingest, str(tmp_path / "checkpoint"), lines=True).awaitTermination(300)

    one.write_text(prompt(1, 0) + reply(1, 1) + prompt(2, 5)[:40])
    # The answer to a call that is written later, and one that never comes.
    two.write_text(answer(3, 31, False) + "{broken\n")
    step()
    one.write_text(prompt(1, 0) + reply(1, 1) + prompt(2, 5) + reply(1, 1.5, 1))
    step()
    # The store is compacted between a call and its answer; a file is written anew.
    ingest.compact()
    assert ingest.store.log.commits() == [] and ingest.store.log.waiting("waiting").count() == 1
    one.write_text(prompt(9, 20) + reply(3, 30) + answer(1, 32, True) + reply(2, 6))
    step()
    whole = Ingest(EventStore(spark, str(tmp_path / "b")), Settings(), defer_rollups=True)
    (tmp_path / "all").mkdir()
    (tmp_path / "all" / "all.jsonl").write_text(
        prompt(1, 0) + reply(1, 1) + reply(1, 1.5, 1) + prompt(2, 5) + reply(2, 6) + prompt(9, 20) + reply(3, 30)
        + answer(3, 31, False) + answer(1, 32, True))
    ts.register(spark)
    whole.run_lines(spark.read.format("transcripts").option("path", str(tmp_path / "all")).load(), 0)
    assert stored(ingest) == stored(whole)
    events, calls = stored(whole)
    assert sorted(s for _, s, _ in calls if s is not None) == [False, True] and len(calls) == 3
    assert {m for e, k, m, _ in events if k == "prompt"} == {"claude-opus-4-8"}
    assert sum(k == "response" for _, k, *_ in events) == 3
    for store in (ingest.store, whole.store):
        waits = {n: 0 if (rows := store.log.waiting(n)) is None else rows.count() for n in OPEN}
        assert waits == {"waiting": 0, "calls": 1, "outcomes": 0}
    # The postings kept by batches and compaction find what a scan of the texts finds.
    texts = ingest.store.read("prompts")
    for query in ("fix number 2", "PLEA", "number", "nothing", "!"):
        want = {r.event_id for r in texts.where(pr.matches(F.col("text"), query)).collect()}
        assert {r.event_id for r in pr.search_index(ingest.store.read("terms"), query).collect()} == want
    # What lies beside the log reads as what is compacted.
    before = stored(ingest)
    ingest.compact()
    plan = pr.search(ingest.store.tables().but(classifications=empty(spark), technologies=empty(spark)), query="fix",
                     index=ingest.store.read("terms"))._jdf.queryExecution().optimizedPlan().toString()
    assert " text#" not in plan and "StartsWith(token" in plan
    ingest.delete(DeleteScope("prompts"))
    assert ingest.store.read("terms") is None
    assert stored(ingest) == before and ingest.store.stored("events").count() == len(before[0])


# -- the append log -----------------------------------------------------------------------------

ROWS = [event(i, "prompt" if i % 2 else "response", i * 700, model=None if i % 2 else "claude-opus-4-8", session_id=f"s{i % 3}")
        for i in range(12)]


def add(store, name, rows, known=()):
    tables = nz.stored_tables(log(store.spark, rows))
    hit = F.col("external_id").isin(*known) if known else F.lit(False)
    store.log.add(name, {"events.added": tables.events.where(~hit), "events.patches": tables.events.where(hit),
                         "keys": tables.events.where(~hit).select("dedupe_key", "local_date", "provider_id")})


def seen(store):
    return sorted((r.external_id, r.git_branch or "", str(r.local_date)) for r in store.read("events").collect())


def filled(spark, path):
    store = EventStore(spark, str(path))
    add(store, "a", ROWS[:6])
    add(store, "b", ROWS[6:] + [{**ROWS[2], "git_branch": "late"}], known=("2",))
    return store


def test_a_batch_counts_from_its_commit_on_and_once(spark, tmp_path):
    store = filled(spark, tmp_path / "s")
    want = seen(store)
    assert [w[:2] for w in want] == sorted((str(i), "late" if i == 2 else "") for i in range(12))
    add(store, "b", ROWS[6:])
    assert seen(store) == want and len(store.log.commits()) == 2
    # Files without their commit are not there; run again they get the same name.
    batch = store.log.commits()[-1]
    text = store.read_text(f"{store.log.root}/commits/{batch}")
    store.remove(f"{store.log.root}/commits/{batch}")
    assert len(seen(store)) == 6
    assert store.log._name("b") == batch
    store.write_text(f"{store.log.root}/commits/{batch}", text)
    assert seen(store) == want


@pytest.mark.parametrize("broken", ["write", "write_text", "remove"])
def test_compaction_may_stop_anywhere(spark, tmp_path, monkeypatch, broken):
    store = filled(spark, tmp_path / "s")
    want = seen(store)
    real, calls = getattr(store, broken), []

    def stop(*args, **kwargs):
        calls.append(args)
        # The record itself is the first text that is written.
        if broken != "write_text" or len(calls) > 1:
            raise OSError("executor lost")
        return real(*args, **kwargs)

    monkeypatch.setattr(store, broken, stop)
    with pytest.raises(OSError):
        store.log.compact()
    monkeypatch.setattr(store, broken, real)
    assert seen(store) == want
    again = EventStore(spark, store.root)
    again.log.compact()
    assert seen(again) == want and again.log.commits() == []
    assert again.stored("events").count() == 12
    assert again.names(f"{again.log.root}/batches") == [] and again.names(f"{again.log.root}/compactions") == []
    add(again, "c", [{**ROWS[5], "git_branch": "new"}], known=("5",))
    assert ("5", "new") in {s[:2] for s in seen(again)}
    assert again.log.commits()[0] > "000000000001"


def test_keys_are_found_in_any_generation(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "MOST_GENERATIONS", 2)
    store = EventStore(spark, str(tmp_path / "s"))
    index = store.keys_index
    keys = spark.range(3000).select(
        F.sha2(F.col("id").cast("string"), 256).alias("dedupe_key"), F.to_date(F.lit("2026-01-01")).alias("local_date"),
        F.lit("p").alias("provider_id"), "id")
    for n in range(4):
        index.add(f"g{n}", keys.where(f"id % 5 = {n}").drop("id"))
    assert len(index.generations()) <= 3 and sum(g["n"] for g in index.generations().values()) == 2400
    asked = keys.where("id % 7 = 0").select("dedupe_key")
    want = {r[0] for r in keys.where("id % 7 = 0 and id % 5 < 4").select("dedupe_key").collect()}
    assert {r.dedupe_key for r in index.known("q", asked).collect()} == want
    # Of keys that are not there few pass the fields.
    new = spark.range(5000, 9000).select(F.sha2(F.col("id").cast("string"), 256).alias("dedupe_key"))
    passed = sum(index.maybe(n, g["bits"], new).count() for n, g in index.generations().items())
    assert passed < 40 and index.known("r", new).count() == 0
    index.rebuild("less", keys.where("id < 10").drop("id"))
    assert {r.dedupe_key for r in index.known("t", asked).collect()} == {
        r[0] for r in keys.where("id in (0, 7)").select("dedupe_key").collect()}


def test_a_batch_reads_no_stored_event_without_a_day_bound(spark, tmp_path):
    """Of the parts of a batch that look at the log, the index names buckets and attribution days."""
    store = EventStore(spark, str(tmp_path / "s"))
    tables = nz.stored_tables(log(spark, ROWS))
    store.write("events", tables.events)
    ingest = Ingest(store, Settings(), defer_rollups=True)
    read, bounds = store.log.read, []
    store.log.read = lambda name: (bounds.append(name), read(name))[1]
    ingest.run(source(spark, [event("n1", "prompt", 9000), event(3, "prompt", 2100, git_branch="x")]), 0)
    assert bounds == ["events"]  # for replies to the new prompt, from two days before it on
    row = ingest.audit().first()
    assert (row.accepted, row.deduped) == (1, 1)
    rows = {r.external_id: r for r in store.read("events").collect()}
    assert len(rows) == 13 and rows["3"].git_branch == "x"
    whole = {r.external_id: r.model for r in asof.link_prompt_models(tables.events).collect()}
    # Prompts that waited when the index began wait on; the first reply after the last one comes now.
    ingest.run(source(spark, [event("r", "response", 12 * 700, model="claude-haiku-4-5", session_id="s2")]), 1)
    found = {r.external_id: r.model for r in store.read("events").collect()}
    assert found["11"] == "claude-haiku-4-5" and whole["11"] is None


def test_only_rollups_of_other_settings_are_rebuilt(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    tables = nz.stored_tables(log(spark, ROWS))
    for name in ("events", "prompts", "responses", "tool_calls"):
        store.write(name, getattr(tables, name))
    days = tables.events.select("local_date", "provider_id").distinct().count()
    assert days > 2
    ingest = Ingest(store, Settings())
    assert [ingest.rebuild_stale(), ingest.rebuild_stale()] == [days, 0]
    other = Ingest(store, Settings(idle_ms=60_000))
    assert [other.rebuild_stale(), other.rebuild_stale()] == [days, 0]
    got = {(r.day, r.active_ms) for r in store.read("daily_active").collect()}
    assert got == {(r.day, r.active_ms) for r in ru.daily_active(tables.events, idle_ms=60_000).collect()}


def test_files_are_listed_without_being_read(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "empty.jsonl").write_text("")
    (tmp_path / "b.jsonl").write_text("x\n")
    (tmp_path / "c.txt").write_text("x\n")
    found = tr.discover(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.source_path), r.file_size) for r in found) == [("b.jsonl", 2)]
