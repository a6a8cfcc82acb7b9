import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import at, event, log, source
from usagelake.contract import EVENT_INPUT, Settings
from usagelake.operators import active, asof, rollups as ru, totals as tt
from usagelake.sources import push
from usagelake.sources.store import EventStore
from usagelake.streaming import live
from usagelake.streaming.ingest import Ingest, backfill

ROWS = [
    event(1, "prompt", 0, prompt="fix the failing test"),
    event(2, "response", 1, model="claude-opus-4-8", input_tokens=100, output_tokens=50),
    event(3, "tool_call", 2, tool_name="Edit", tool_succeeded=True),
    event(4, "prompt", 900, prompt="deploy with docker"),
    event(5, "response", 901, model="claude-haiku-4-5", input_tokens=10, output_tokens=5),
]


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_batches_give_the_same_log_in_any_cut(spark, tmp_path):
    whole = Ingest(EventStore(spark, str(tmp_path / "a")), Settings())
    whole.run(source(spark, ROWS), 0)
    cut = Ingest(EventStore(spark, str(tmp_path / "b")), Settings())
    # The reply arrives before the prompt's batch, and one batch is delivered twice.
    cut.run(source(spark, ROWS[1:3]), 0)
    cut.run(source(spark, ROWS[:1] + ROWS[3:4]), 1)
    cut.run(source(spark, ROWS[4:]), 2)
    cut.run(source(spark, ROWS[4:]), 3)
    cut.run(source(spark, ROWS[4:]), 3)
    for name, columns in (
        ("events", ("event_id", "model", "local_date", "session_id", "input_tokens")),
        ("prompts", ("event_id", "text")), ("tool_calls", ("event_id", "tool_name")),
        ("daily_rollups", ("day", "provider_id", "model", "prompts", "responses", "sessions")),
        ("daily_active", ("day", "provider_id", "active_ms", "sessions")),
        ("providers", ("provider_id", "name", "last_event_ms")),
    ):
        assert rows_of(whole.store.read(name), *columns) == rows_of(cut.store.read(name), *columns), name
    audit = {r.batch_id: r for r in cut.audit().collect()}
    assert (audit["push-3"].accepted, audit["push-3"].deduped) == (0, 1)
    models = dict(whole.store.read("events").where("event_type = 'prompt'")
                  .select("external_id", "model").collect())
    assert models == {"1": "claude-opus-4-8", "4": "claude-haiku-4-5"}


def test_late_event_refreshes_the_next_day(spark, tmp_path):
    ingest = Ingest(EventStore(spark, str(tmp_path / "s")), Settings())
    late_night = 14 * 60 + 50  # 23:50
    ingest.run(source(spark, [event(1, minutes=late_night - 60), event(2, minutes=late_night + 13)]), 0)
    ingest.run(source(spark, [event(3, minutes=late_night)]), 1)
    got = rows_of(ingest.store.read("daily_active"), "day", "active_ms")
    want = rows_of(ru.daily_active(ingest.store.read("events")), "day", "active_ms")
    assert got == want


def test_invalid_and_paused_events_are_counted(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    store.write("providers", spark.createDataFrame(
        [("tool-b", "B", False, None)],
        "provider_id string, name string, enabled boolean, last_event_ms bigint"))
    ingest = Ingest(store, Settings())
    ingest.run(source(spark, [
        event(1), event(2, timestamp="+057615-06-05T00:00:00.000Z"),
        event(3, provider_id="tool-b"), event(4, input_tokens=-1), event(5, "nonsense"),
    ]), 0)
    row = ingest.audit().first()
    assert (row.accepted, row.failed, row.skipped) == (1, 3, 1)
    names = dict(store.read("providers").select("provider_id", "name").collect())
    assert names == {"tool-a": "Tool A", "tool-b": "B"}


def test_deferred_rollups_and_enrichment(spark, tmp_path):
    ingest = Ingest(EventStore(spark, str(tmp_path / "s")), Settings(), defer_rollups=True)
    ingest.run(source(spark, ROWS), 0)
    assert ingest.store.read("daily_rollups") is None
    ingest.rebuild()
    ingest.enrich()
    got = dict(ingest.store.read("classifications").join(
        ingest.store.read("events"), "event_id").select("external_id", "category").collect())
    assert got == {"1": "Testing", "4": "DevOps"} or got["4"] == "DevOps"
    rolled = ingest.store.read("daily_rollups").where("category = 'DevOps'")
    assert rolled.agg(F.sum("prompts")).first()[0] == 1
    from usagelake.operators.enrichment import pending_count
    assert pending_count(ingest.store.read("events")).first()[0] == 0


def test_backfill_from_a_landing_directory(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    for n in range(3):
        batch = {"providerId": "pushy", "events": [
            {"externalId": f"{n}-{i}", "timestamp": at(n * 10 + i), "eventType": "prompt",
             "prompt": f"hello {i}", "sessionId": "x", "metadata": {"a": {"b": 1}}}
            for i in range(4)]}
        (landing / f"b{n}.json").write_text(json.dumps(batch, indent=1))
    ingest = Ingest(EventStore(spark, str(tmp_path / "s")), Settings())
    stream = push.stream_batches(spark, str(landing), max_files=2)
    query = backfill(stream, ingest, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert ingest.store.read("events").count() == 12
    # The same checkpoint has nothing left to do; the same files read as a batch change nothing.
    again = backfill(push.stream_batches(spark, str(landing)), ingest, str(tmp_path / "checkpoint"))
    again.awaitTermination(60)
    ingest.run(push.read_batches(spark, str(landing)), "re-read")
    assert ingest.store.read("events").count() == 12
    assert ingest.store.read("prompts").count() == 12


def test_no_push_batch_vanishes(spark, tmp_path):
    one = {"timestamp": at(0), "eventType": "prompt"}
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "big.json").write_text(json.dumps({"providerId": "p", "events": [
        {**one, "externalId": str(i)} for i in range(2001)]}))
    (landing / "none.json").write_text(json.dumps({"providerId": "p", "events": []}))
    (landing / "anonymous.json").write_text(json.dumps({"events": [one, {**one, "providerId": "q"}]}))
    got = push.read_batches(spark, str(landing))
    assert got.columns == [f for f in EVENT_INPUT.fieldNames()]
    ingest = Ingest(EventStore(spark, str(tmp_path / "s")), Settings())
    ingest.run(got, 0)
    row = ingest.audit().first()
    assert (row.accepted, row.failed) == (2002, 2)


@pytest.fixture
def stream_dir(spark, tmp_path):
    rows = [event(i, "prompt" if i % 3 else "response", m, session_id=f"s{i % 2}")
            for i, m in enumerate((0, 1, 2, 9, 10, 30, 31, 45, 200, 201, 203, 900))]
    path = str(tmp_path / "log")
    log(spark, rows).drop("prompt", "response", "tool_call").write.parquet(path)
    return path


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_live_active_time_equals_batch(spark, stream_dir):
    static = spark.read.parquet(stream_dir)
    stream = spark.readStream.schema(static.schema).parquet(stream_dir)
    seen = drain(live.bursts(stream, 300_000), "bursts", "complete")
    got = rows_of(live.active_from_bursts(seen), "session_id", "active_ms")
    want = rows_of(active.active_time(static, ["session_id"]), "session_id", "active_ms")
    assert got == want
    assert rows_of(live.active_from_bursts(live.bursts(static)), "session_id", "active_ms") == want


def test_live_hourly_counts(spark, stream_dir):
    static = spark.read.parquet(stream_dir)
    stream = spark.readStream.schema(static.schema).parquet(stream_dir)
    got = drain(live.hourly_counts(stream), "hourly", "update")
    assert got.agg(F.sum("events")).first()[0] == 12


def test_near_duplicates_are_dropped(spark, stream_dir):
    static = spark.read.parquet(stream_dir)
    one = spark.readStream.schema(static.schema).parquet(stream_dir)
    two = spark.readStream.schema(static.schema).parquet(stream_dir)
    got = drain(live.deduplicated(one.union(two)), "deduped")
    assert got.count() == 12


def test_prompt_model_passes_are_repeatable(spark, stream_dir):
    static = spark.read.parquet(stream_dir)
    once = asof.link_prompt_models(static)
    twice = asof.link_prompt_models(once.drop("linked"))
    assert twice.where("linked").count() == 0
    assert tt.counters(once).first().prompts == 8


def test_two_streams_with_equal_batch_ids_lose_nothing(spark, tmp_path):
    store = EventStore(spark, str(tmp_path / "s"))
    Ingest(store, Settings()).run(source(spark, ROWS[:2]), 0)
    Ingest(store, Settings()).run(source(spark, ROWS[2:]), 0)
    assert store.read("events").count() == len(ROWS)
    assert not (tmp_path / "s" / "_staging").exists() or not any((tmp_path / "s" / "_staging").iterdir())


def test_enriching_again_after_another_batch(spark, tmp_path):
    ingest = Ingest(EventStore(spark, str(tmp_path / "s")), Settings())
    ingest.run(source(spark, ROWS[:1]), 0)
    ingest.enrich()
    ingest.run(source(spark, ROWS[3:4]), 1)
    ingest.enrich()
    assert ingest.store.read("events").count() == 2
    assert ingest.store.read("classifications").count() == 2


@pytest.fixture
def filled(spark, tmp_path):
    ingest = Ingest(EventStore(spark, str(tmp_path / "s")), Settings(store_responses=True, retention_months=1))
    later = [event(10, "prompt", 3 * 1440, prompt="next week"),
             event(11, "response", 3 * 1440 + 1, model="claude-opus-4-8", response="an answer")]
    ingest.run(source(spark, ROWS + later), 0)
    ingest.enrich()
    return ingest


SETS = ("events", "prompts", "responses", "tool_calls", "classifications", "technologies", "contexts", "projects",
        "daily_rollups", "daily_active")


def left(ingest):
    found = {name: ingest.store.read(name) for name in SETS}
    return {name: 0 if df is None else df.count() for name, df in found.items()}


def test_deleting_everything_reaches_the_disk(filled):
    from usagelake.operators.maintenance import DeleteScope

    filled.delete(DeleteScope("all"))
    assert set(left(filled).values()) == {0}


def test_erasing_text_reaches_the_disk(filled):
    from usagelake.operators.maintenance import DeleteScope

    before = left(filled)
    filled.delete(DeleteScope("prompts"))
    assert left(filled) == {**before, "responses": 0}
    assert filled.store.read("prompts").where("text IS NOT NULL OR preview IS NOT NULL").count() == 0


def test_deleting_a_range_rebuilds_its_days(spark, filled):
    import datetime as dt

    from tests.helpers import BASE
    from usagelake.operators.maintenance import DeleteScope

    filled.delete(DeleteScope("range", from_ts=BASE - dt.timedelta(days=1), to_ts=BASE + dt.timedelta(days=1)))
    store = filled.store
    assert {r.external_id for r in store.read("events").collect()} == {"10", "11"}
    assert store.read("daily_rollups").select("day").distinct().count() == 1
    assert rows_of(store.read("daily_active"), "day", "active_ms") == rows_of(
        ru.daily_active(store.read("events")), "day", "active_ms")


def test_retention_reaches_the_disk(filled):
    import datetime as dt

    from tests.helpers import BASE

    filled.retain(as_of=BASE + dt.timedelta(days=33))
    kept = filled.store.read("prompts").where("text IS NOT NULL")
    assert [r.text for r in kept.collect()] == ["next week"]
    assert filled.store.read("prompts").count() == 3


def test_a_batch_of_lines_reads_its_records_once(spark, tmp_path, monkeypatch):
    seen = []

    def run(self, events, batch_id, outcomes=None):
        seen.append(events.collect())
        seen.extend(f._jdf.queryExecution().optimizedPlan().toString() for f in (events, outcomes))

    monkeypatch.setattr(Ingest, "run", run)
    record = json.dumps({"type": "user", "uuid": "u", "timestamp": at(0), "sessionId": "s", "message": {"content": "hi"}})
    Ingest(EventStore(spark, str(tmp_path))).run_lines(spark.createDataFrame([(record, "f")], "value string, source_path string"), 0)
    assert [r["prompt"] for r in seen[0]] == ["hi"]
    assert not any("try_parse_json" in plan or "variant_get" in plan for plan in seen[1:])
