"""Questions about ingest: contract, normalisation, keys, attribution, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.contract import EVENT_TYPES, Settings
from usagelake.functions import ids, pricing, redaction, timeutil
from usagelake.functions import text as tx
from usagelake.operators import asof, merge, normalize as nz, projects as pj, sessions as ss
from usagelake.sources import manifests, transcripts as tr
from workload import transcripts as wt
from workload import views as v
from workload.oracle_base import (
    ALL, LOG, RAW, TEXT, WS, normalized, preview, q, utf16, with_,
)
from workload.registry import query

EV = with_(*LOG)
PRS = with_(*TEXT)


@query("normalized_events", EV + """
SELECT event_id, dedupe_key, provider_id, model, model_family, ts_ms, tz_offset_minutes,
  local_date::VARCHAR AS local_date, local_hour, local_weekday, session_id, project_id,
  is_subagent::BIGINT AS is_subagent, event_type, input_tokens, round(cost, 6) AS cost FROM ev""")
def _(spark, sf):
    return nz.normalize(v.raw_log(spark, sf), v.SETTINGS).select(
        "event_id", "dedupe_key", "provider_id", "model", "model_family", "ts_ms",
        "tz_offset_minutes", "local_date", "local_hour", "local_weekday", "session_id",
        "project_id", "is_subagent", "event_type", "input_tokens",
        F.col("estimated_cost_usd").alias("cost"),
    )


@query("contract_validation", f"""
WITH o AS (
  SELECT CASE WHEN o_orderkey % 9 <> 0 THEN repeat('p', (o_custkey % 70 + 1)::INT) END AS provider,
    o_custkey % 2000 - 1000 AS tz, CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority)
      ELSE 'prompt' END AS event_type, floor(o_totalprice)::BIGINT - 20000 AS tokens,
    repeat('m', (o_orderkey % 140)::INT) AS model,
    CASE WHEN o_orderkey % 11 = 0 THEN 'not a time' WHEN o_orderkey % 11 = 1 THEN '+33658-01-01T00:00:00Z'
      ELSE 'ok' END AS ts
  FROM orders
)
SELECT failed_rules, count(*)::BIGINT AS events FROM (
  SELECT array_to_string(list_filter([
    CASE WHEN provider IS NULL OR length(provider) > 64 THEN 'provider_id' END,
    CASE WHEN ts <> 'ok' THEN 'timestamp' END,
    CASE WHEN tz NOT BETWEEN -900 AND 900 THEN 'tz_offset_minutes' END,
    CASE WHEN event_type NOT IN ({', '.join(q(e) for e in EVENT_TYPES)}) THEN 'event_type' END,
    CASE WHEN length(model) > 128 THEN 'model' END,
    CASE WHEN tokens < 0 THEN 'input_tokens' END], lambda x: x IS NOT NULL), '|') AS failed_rules FROM o)
GROUP BY 1""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    events = v.load(spark, sf, "orders").select(
        F.when(k % 9 != 0, F.expr("repeat('p', cast(o_custkey % 70 + 1 as int))"))
        .alias("provider_id"),
        (c % 2000 - 1000).cast("int").alias("tz_offset_minutes"),
        F.when(k % 5 == 0, F.lower("o_orderpriority")).otherwise("prompt").alias("event_type"),
        (F.floor("o_totalprice") - 20000).alias("input_tokens"),
        F.expr("repeat('m', cast(o_orderkey % 140 as int))").alias("model"),
        F.when(k % 11 == 0, "not a time").when(k % 11 == 1, "+33658-01-01T00:00:00Z")
        .otherwise(F.concat(F.col("o_orderdate").cast("date").cast("string"),
                            F.lit("T10:00:00.000Z"))).alias("timestamp"),
    )
    checked = nz.validate(nz.conform(events))
    return checked.groupBy(F.array_join("failed_rules", "|").alias("failed_rules")).agg(
        F.count(F.lit(1)).alias("events")
    )


@query("local_stamps", """
SELECT o_orderkey AS id, (DATE '1970-01-01' + (lms // 86400000)::INT)::VARCHAR AS local_date,
  ((lms % 86400000) // 3600000)::BIGINT AS local_hour, ((lms // 86400000 + 4) % 7)::BIGINT AS local_weekday
FROM (SELECT o_orderkey, epoch_ms(o_orderdate::TIMESTAMP) + (o_custkey % 1440) * 60000
        + (o_custkey % 1801 - 900) * 60000 AS lms FROM orders)""")
def _(spark, sf):
    o = v.load(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    ms = day.cast("bigint") * 86_400_000 + F.col("o_custkey") % 1440 * 60_000
    offset = F.col("o_custkey") % 1801 - 900
    return o.select(
        F.col("o_orderkey").alias("id"), timeutil.local_date(ms, offset).alias("local_date"),
        timeutil.local_hour(ms, offset).alias("local_hour"),
        timeutil.local_weekday(ms, offset).alias("local_weekday"),
    )


@query("zone_offsets", """
SELECT o_orderkey AS id, ((epoch_ms(timezone('America/New_York', timezone('UTC', ts))) - epoch_ms(ts)) // 60000)::BIGINT AS offset_minutes,
  timezone('Europe/Berlin', timezone('UTC', ts))::DATE::VARCHAR AS berlin_date,
  epoch_ms(timezone('UTC', timezone('America/New_York', o_orderdate::DATE::TIMESTAMP)))::BIGINT AS day_start_ms,
  epoch_ms(timezone('UTC', timezone('America/New_York', o_orderdate::DATE::TIMESTAMP + INTERVAL '86399999 milliseconds')))::BIGINT AS day_end_ms
FROM (SELECT o_orderkey, o_orderdate, o_orderdate::TIMESTAMP + to_minutes((o_custkey % 1440)::BIGINT) AS ts FROM orders)""")
def _(spark, sf):
    o = v.load(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    ms = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000
    ts = F.timestamp_millis(ms + F.col("o_custkey") % 1440 * 60_000)
    return o.select(
        F.col("o_orderkey").alias("id"),
        timeutil.zone_offset_minutes(ts, "America/New_York").alias("offset_minutes"),
        timeutil.local_date_in(ts, "Europe/Berlin").alias("berlin_date"),
        timeutil.local_day_start_ms(day, "America/New_York").alias("day_start_ms"),
        timeutil.local_day_end_ms(day, "America/New_York").alias("day_end_ms"),
    )


@query("local_day_arithmetic", """
SELECT o_orderkey AS id, (o_orderdate::DATE + (o_custkey % 400 - 200)::INT)::VARCHAR AS shifted,
  date_diff('day', DATE '1995-06-17', o_orderdate::DATE)::BIGINT AS days,
  strftime(o_orderdate::DATE, '%Y-W%W') AS week FROM orders""")
def _(spark, sf):
    day = F.col("o_orderdate").cast("date")
    return v.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        timeutil.add_local_days(day, (F.col("o_custkey") % 400 - 200).cast("int")).alias("shifted"),
        timeutil.diff_local_days(F.lit("1995-06-17").cast("date"), day).alias("days"),
        timeutil.week_bucket(day).alias("week"),
    )


@query("model_costs", EV + """
SELECT model, model_family, count(*)::BIGINT AS events, count(cost)::BIGINT AS priced,
  round(sum(cost), 6) AS cost FROM ev WHERE event_type = 'response' GROUP BY ALL""")
def _(spark, sf):
    raw = v.raw_log(spark, sf).where(F.col("event_type") == "response")
    usage = pricing.Usage(*[F.col(c) for c in (
        "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens",
        "cache_write_1h_tokens")])
    priced = raw.withColumn("price", pricing.price_of(F.col("model"))).withColumn(
        "c", pricing.estimate_cost_usd(F.col("price"), usage)
    )
    return priced.groupBy("model", ids.model_family(F.col("model")).alias("model_family")).agg(
        F.count(F.lit(1)).alias("events"), F.count("c").alias("priced"), F.sum("c").alias("cost")
    )


@query("price_lookup", with_(RAW) + """
SELECT DISTINCT lower(model) AS model, CASE lower(model)
  WHEN 'claude-opus-4-8' THEN 5.0 WHEN 'claude-sonnet-4-5-20250929' THEN 3.0
  WHEN 'claude-haiku-4-5' THEN 1.0 WHEN 'claude-sonnet-4-5' THEN 3.0
  WHEN 'claude-opus-4-1' THEN 15.0 END::DOUBLE AS input_usd FROM raw WHERE model IS NOT NULL""")
def _(spark, sf):
    named = v.raw_log(spark, sf).where(F.col("model").isNotNull())
    return named.select(
        F.lower("model").alias("model"),
        pricing.price_of(F.col("model"))["input"].alias("input_usd"),
    ).distinct()


@query("project_dimension", with_(*ALL[:3]) + """
SELECT project_id, path, name, first_ms AS first_seen_ms, last_ms AS last_seen_ms FROM projects_d""")
def _(spark, sf):
    return v.tables(spark, sf).projects.select(
        "project_id", "path", "name", "first_seen_ms", "last_seen_ms"
    )


@query("provider_registration", with_(*ALL[:3]) + """
SELECT DISTINCT ev.provider_id, CASE ev.provider_id WHEN 'gamma.chat' THEN 'Gamma Chat' END AS name
FROM ev ANTI JOIN providers_d USING (provider_id)""")
def _(spark, sf):
    t = v.tables(spark, sf)
    return nz.register_providers(t.events, t.providers).select("provider_id", "name")


@query("paused_provider_skipped", with_(*ALL[:3]) + """
SELECT ev.provider_id, count(*)::BIGINT AS events FROM ev
ANTI JOIN (SELECT * FROM providers_d WHERE NOT enabled) p USING (provider_id) GROUP BY 1""")
def _(spark, sf):
    t = v.tables(spark, sf)
    return nz.drop_paused(t.events, t.providers).groupBy("provider_id").agg(
        F.count(F.lit(1)).alias("events")
    )


@query("project_roots", EV + """, roots AS (
  SELECT DISTINCT '/home/dev/p' || d AS path, 'git@host.example:team/p' || d || '.git' AS remote
  FROM (SELECT regexp_extract(props, '(\\d+)', 1)::INT % 10 AS d FROM events) WHERE d % 2 = 0
  UNION ALL
  SELECT DISTINCT '/home/dev/p' || d || '/src', NULL
  FROM (SELECT regexp_extract(props, '(\\d+)', 1)::INT % 10 AS d FROM events) WHERE d % 4 = 0)
SELECT w AS working_directory, coalesce(r.path, w) AS project_path, remote AS git_remote,
  nullif(regexp_extract(regexp_replace(coalesce(remote, ''), '\\.git$', ''), '[:/]([^/:]+/[^/:]+)$', 1), '') AS repository
FROM (SELECT DISTINCT working_directory AS w FROM ev WHERE working_directory IS NOT NULL)
LEFT JOIN LATERAL (SELECT path, remote FROM roots
  WHERE w LIKE '/%' AND (w = path OR starts_with(w, path || '/')) ORDER BY length(path) DESC LIMIT 1) r ON true""")
def _(spark, sf):
    e = v.load(spark, sf, "events")
    digit = (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 10).cast("string")
    base = e.select(digit.alias("d")).distinct()
    top = base.where(F.col("d").cast("int") % 2 == 0).select(
        F.concat(F.lit("/home/dev/p"), "d").alias("path"),
        F.concat(F.lit("git@host.example:team/p"), "d", F.lit(".git")).alias("git_remote"),
    )
    nested = base.where(F.col("d").cast("int") % 4 == 0).select(
        F.concat(F.lit("/home/dev/p"), "d", F.lit("/src")).alias("path"),
        F.lit(None).cast("string").alias("git_remote"),
    )
    roots = pj.resolve_roots(v.tables(spark, sf).events, top.unionByName(nested))
    return roots.withColumn("repository", ids.repository_name(F.col("git_remote")))


@query("prompt_measures", PRS + """
SELECT event_id, text_hash, normalized_hash, char_length::BIGINT AS char_length,
  word_length::BIGINT AS word_length, redaction_count::BIGINT AS redaction_count, preview FROM prompts_d""")
def _(spark, sf):
    return v.tables(spark, sf).prompts.select(
        "event_id", "text_hash", "normalized_hash", "char_length", "word_length",
        "redaction_count", "preview",
    )


@query("document_fingerprints", f"""
SELECT doc_id, sha256({normalized('text')}) AS fingerprint, {utf16('text')}::BIGINT AS chars,
  length(regexp_extract_all(text, '[^{WS}]+'))::BIGINT AS words, {preview('text')} AS preview FROM documents""")
def _(spark, sf):
    text = F.col("text")
    from usagelake.functions.exprs import utf16_length

    return v.load_spread(spark, sf, "documents").select(
        "doc_id", tx.fingerprint(text).alias("fingerprint"), utf16_length(text).alias("chars"),
        tx.word_count(text).alias("words"), tx.preview(text).alias("preview"),
    )


@query("text_extensions", r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(
  regexp_extract_all(text, '[\w./\\@-]*\.([A-Za-z0-9]{1,8})\b', 1), lambda x: lower(x)))), '|') AS extensions FROM documents""")
def _(spark, sf):
    return v.load_spread(spark, sf, "documents").select(
        "doc_id", F.array_sort(tx.extensions_in(F.col("text"))).alias("extensions")
    )


@query("redacted_prompts", PRS + """
SELECT event_id, sha256(text) AS stored_hash, redaction_count::BIGINT AS redactions, kinds FROM prompts_d""")
def _(spark, sf):
    log = nz.normalize(v.raw_log(spark, sf), v.SETTINGS, with_kinds=True)
    rows = log.where(F.col("event_type") == "prompt").select(
        "event_id", F.explode(F.array_compact(F.array("prompt"))).alias("p")
    )
    return rows.select(
        "event_id", F.sha2("p.text", 256).alias("stored_hash"),
        F.col("p.redaction_count").alias("redactions"), F.col("p.redaction_kinds").alias("kinds"),
    )


@query("redaction_kinds", PRS + """
SELECT kind, count(*)::BIGINT AS prompts FROM (
  SELECT unnest(string_split(kinds, '|')) AS kind FROM prompts_d WHERE kinds <> '') GROUP BY 1""")
def _(spark, sf):
    prompts = v.raw_log(spark, sf).where(
        (F.col("event_type") == "prompt") & F.col("prompt").isNotNull()
    )
    kinds = prompts.select(F.explode(redaction.redact(F.col("prompt"))["kinds"]).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("prompts"))


@query("metadata_redaction", """
SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN '{"env":["TOKEN=1","Bearer [redacted:bearer_token]"],"n":' || event_id || '}'
  WHEN event_id % 4 = 1 THEN '{"apiKey":"plain-value-1"}'
  WHEN event_id % 4 = 2 THEN '{"nested":{"header":"password=[redacted:assigned_secret]"}}'
  ELSE '{"k":"v"}' END AS metadata FROM events""")
def _(spark, sf):
    i = F.col("event_id")
    metadata = (
        F.when(i % 4 == 0, F.concat(
            F.lit('{"env":["TOKEN=1","Bearer abcdefghijklmnop12"],"n":'), i.cast("string"),
            F.lit("}")))
        .when(i % 4 == 1, '{"apiKey":"plain-value-1"}')
        .when(i % 4 == 2, '{"nested":{"header":"password=hunter2hunter2"}}')
        .otherwise('{"k":"v"}')
    )
    return v.load(spark, sf, "events").select(
        i.alias("id"), redaction.redact_json(metadata).alias("metadata")
    )


@query("metadata_only_prompts", PRS + """
SELECT count(*)::BIGINT AS prompts, 0::BIGINT AS with_text, sum(char_length)::BIGINT AS chars,
  sum(redaction_count)::BIGINT AS redactions, 0::BIGINT AS replies_with_text FROM prompts_d""")
def _(spark, sf):
    log = nz.normalize(v.raw_log(spark, sf), Settings(timezone=v.ZONE, metadata_only=True,
                                                      store_responses=True))
    t = nz.split_tables(log)
    kept = t.responses.agg(F.count("text")).scalar()
    return t.prompts.agg(
        F.count(F.lit(1)).alias("prompts"), F.count("text").alias("with_text"),
        F.sum("char_length").alias("chars"), F.sum("redaction_count").alias("redactions"),
    ).withColumn("replies_with_text", kept)


@query("response_retention", EV + f"""
SELECT count(*)::BIGINT AS responses, count(response)::BIGINT AS with_text,
  sum({utf16('response')})::BIGINT AS chars FROM ev WHERE event_type = 'response' AND response IS NOT NULL""")
def _(spark, sf):
    return v.tables(spark, sf).responses.agg(
        F.count(F.lit(1)).alias("responses"), F.count("text").alias("with_text"),
        F.sum("char_length").alias("chars"),
    )


@query("tool_call_rows", EV + """
SELECT event_id, tool_name, tool_ok::BIGINT AS succeeded, duration_ms, ext AS target_extension
FROM ev WHERE event_type = 'tool_call'""")
def _(spark, sf):
    return v.tables(spark, sf).tool_calls.select(
        "event_id", "tool_name", "succeeded", "duration_ms", "target_extension"
    )


@query("prompt_model_attribution", EV + """, linked AS (
  SELECT p.event_id, arg_min(r.model, {'t': r.ts_ms, 'i': r.event_id}) AS model
  FROM ev p JOIN ev r ON r.session_id = p.session_id AND r.is_subagent = p.is_subagent
    AND r.event_type = 'response' AND r.model NOT LIKE '<%' AND r.ts_ms >= p.ts_ms
  WHERE p.event_type = 'prompt' AND p.model IS NULL GROUP BY 1)
SELECT ev.event_id, coalesce(ev.model, linked.model) AS model, (linked.model IS NOT NULL)::BIGINT AS linked
FROM ev LEFT JOIN linked USING (event_id) WHERE event_type = 'prompt'""")
def _(spark, sf):
    linked = asof.link_prompt_models(v.tables(spark, sf).events)
    return linked.where(F.col("event_type") == "prompt").select("event_id", "model", "linked")


@query("attribution_touched_days", EV + """
SELECT DISTINCT p.local_date::VARCHAR AS local_date, p.provider_id FROM ev p
WHERE p.event_type = 'prompt' AND p.model IS NULL AND EXISTS (
  SELECT 1 FROM ev r WHERE r.session_id = p.session_id AND r.is_subagent = p.is_subagent
    AND r.event_type = 'response' AND r.model NOT LIKE '<%' AND r.ts_ms >= p.ts_ms)""")
def _(spark, sf):
    return asof.changed_days(asof.link_prompt_models(v.tables(spark, sf).events))


@query("following_tools", EV + """
SELECT p.event_id, coalesce(array_to_string(list_sort(list(DISTINCT t.tool_name) FILTER (t.tool_name IS NOT NULL)), '|'), '') AS tool_names
FROM ev p LEFT JOIN ev t ON t.session_id = p.session_id AND t.event_type = 'tool_call'
  AND t.ts_ms > p.ts_ms AND t.ts_ms <= p.ts_ms + 300000
WHERE p.event_type = 'prompt' AND p.session_id IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    t = v.tables(spark, sf)
    return asof.following_tools(t.events, t.tool_calls)


@query("next_response", EV + """
SELECT p.event_id, arg_min(r.event_id, {'t': r.ts_ms, 'i': r.event_id}) AS response_event_id,
  sha256(arg_min(r.response, {'t': r.ts_ms, 'i': r.event_id})) AS response_hash
FROM ev p LEFT JOIN ev r ON r.session_id = p.session_id AND r.event_type = 'response'
  AND r.response IS NOT NULL AND r.ts_ms > p.ts_ms
WHERE p.event_type = 'prompt' AND p.session_id IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    t = v.tables(spark, sf)
    return asof.next_responses(t.events, t.responses).select(
        "event_id", "response_event_id", F.sha2("response_text", 256).alias("response_hash")
    )


def _copies(spark, sf):
    """Two overlapping deliveries of the event rows: the second fills and contradicts the first."""
    own = v.tables(spark, sf).events.withColumn(
        "n", F.conv(F.substring("dedupe_key", 1, 8), 16, 10).cast("bigint"))
    stored = own.where(F.col("n") % 3 != 0).withColumn(
        "model", F.when(F.col("n") % 2 == 0, F.col("model"))
    ).withColumn("ingest_version", F.when(F.col("n") % 10 == 0, 2).otherwise(1))
    incoming = own.where(F.col("n") % 3 != 1).withColumn(
        "input_tokens", F.coalesce("input_tokens", F.col("n"))
    ).withColumn("session_id", F.lit("other"))
    return stored, incoming


MERGE_SQL = """, own AS (
  SELECT *, ('0x' || substr(dedupe_key, 1, 8))::BIGINT AS n FROM ev
), s AS (
  SELECT dedupe_key, CASE WHEN n % 2 = 0 THEN model END AS model, session_id, input_tokens,
    CASE WHEN n % 10 = 0 THEN 2 ELSE 1 END AS v FROM own WHERE n % 3 <> 0
), i AS (
  SELECT dedupe_key, model, 'other' AS session_id, coalesce(input_tokens, n) AS input_tokens FROM own WHERE n % 3 <> 1
)"""


@query("idempotent_merge", EV + MERGE_SQL + """
SELECT dedupe_key, CASE WHEN s.v IS NULL THEN i.model WHEN s.v <= 1 THEN coalesce(s.model, i.model) ELSE s.model END AS model,
  CASE WHEN s.v IS NULL THEN i.session_id WHEN s.v <= 1 THEN coalesce(s.session_id, i.session_id) ELSE s.session_id END AS session_id,
  CASE WHEN s.v IS NULL THEN i.input_tokens WHEN s.v <= 1 THEN coalesce(s.input_tokens, i.input_tokens) ELSE s.input_tokens END AS input_tokens,
  coalesce(s.v, 1)::BIGINT AS ingest_version
FROM s FULL JOIN i USING (dedupe_key)""")
def _(spark, sf):
    stored, incoming = _copies(spark, sf)
    asked = ["dedupe_key", "model", "session_id", "input_tokens", "ingest_version"]
    once = merge.merge_events(stored, incoming, columns=asked)
    # A second delivery of the same batch must change nothing.
    return merge.merge_events(once, incoming, columns=asked)


@query("merge_counts", EV + MERGE_SQL + """
SELECT count(*) FILTER (s.v IS NULL)::BIGINT AS accepted, count(*) FILTER (s.v IS NOT NULL)::BIGINT AS deduped
FROM i LEFT JOIN s USING (dedupe_key)""")
def _(spark, sf):
    return merge.merge_outcome(*_copies(spark, sf))


@query("existing_dedupe_keys", EV + MERGE_SQL + """
SELECT DISTINCT dedupe_key FROM i SEMI JOIN s USING (dedupe_key)""")
def _(spark, sf):
    stored, incoming = _copies(spark, sf)
    return merge.existing_keys(stored, incoming)


@query("touched_days", EV + """
SELECT DISTINCT local_date::VARCHAR AS local_date, provider_id FROM ev
WHERE event_type IN ('prompt', 'tool_call')""")
def _(spark, sf):
    e = v.tables(spark, sf).events
    return merge.union_touched(
        merge.touched_days(e.where(F.col("event_type") == "prompt")),
        merge.touched_days(e.where(F.col("event_type") == "tool_call")),
    )


@query("new_projects", EV + """
SELECT DISTINCT project_id, working_directory AS project_path FROM ev WHERE project_id IS NOT NULL""")
def _(spark, sf):
    return merge.new_projects(v.tables(spark, sf).events)


@query("merged_sessions", EV + """, b AS (
  SELECT *, ts_ms % 2 AS half FROM ev WHERE session_id IS NOT NULL
), h AS (
  SELECT session_id, half, min(ts_ms) AS a, max(ts_ms) AS z,
    arg_min(model, {'t': ts_ms, 'i': event_id}) FILTER (model IS NOT NULL) AS model,
    arg_min(project_id, {'t': ts_ms, 'i': event_id}) FILTER (project_id IS NOT NULL) AS project
  FROM b GROUP BY 1, 2
)
SELECT session_id, min(a) AS started_ms, max(z) AS ended_ms,
  coalesce(max(model) FILTER (half = 1), max(model) FILTER (half = 0)) AS primary_model,
  coalesce(max(project) FILTER (half = 1), max(project) FILTER (half = 0)) AS project_id
FROM h GROUP BY 1""")
def _(spark, sf):
    e = v.tables(spark, sf).events
    first = ss.session_boundaries(e.where(F.col("ts_ms") % 2 == 0))
    second = ss.session_boundaries(e.where(F.col("ts_ms") % 2 == 1))
    return ss.merge_sessions(first, second).select(
        "session_id", "started_ms", "ended_ms", "primary_model", "project_id"
    )


@query("merged_projects", with_(*ALL[:3]) + """
SELECT project_id, path, name, first_ms AS first_seen_ms, last_ms AS last_seen_ms FROM projects_d""")
def _(spark, sf):
    log = v.store(spark, sf).read("log")
    halves = [nz.project_rows(log.where(F.col("ts_ms") % 2 == h)) for h in (0, 1)]
    return pj.merge_projects(*halves).select(
        "project_id", "path", "name", "first_seen_ms", "last_seen_ms"
    )


TRANSCRIPT = """WITH c AS (SELECT *, conv_id || '-' || turn AS name FROM conversations)
"""


@query("transcript_events", TRANSCRIPT + """
SELECT name || '-u' AS external_id, 'prompt' AS event_type, NULL::VARCHAR AS tool_name, NULL::BIGINT AS succeeded,
  NULL::BIGINT AS input_tokens, sha256(CASE WHEN turn % 4 = 0 THEN text ELSE trim(text) END) AS text_hash, 1::BIGINT AS copies FROM c WHERE role = 'user'
UNION ALL SELECT 'msg-' || name, 'response', NULL, NULL, length(text), NULL, 2 FROM c WHERE role = 'assistant'
UNION ALL SELECT 'tool-' || name, 'tool_call', CASE WHEN turn % 3 = 0 THEN 'Edit' ELSE 'Read' END,
  (turn % 4 <> 1)::BIGINT, NULL, NULL, 2 FROM c WHERE role = 'assistant'
UNION ALL SELECT name || '-s', 'compaction', NULL, NULL, NULL, NULL, 1 FROM c WHERE role = 'system'""")
def _(spark, sf):
    parsed = tr.parse(tr.read_lines(spark, wt.directory(spark, sf), pattern=wt.PATTERN))
    events = tr.transcript_events(parsed)
    return events.groupBy("external_id", "event_type", "tool_name").agg(
        F.max("tool_succeeded").alias("succeeded"), F.max("input_tokens").alias("input_tokens"),
        F.max(F.sha2("prompt", 256)).alias("text_hash"), F.count(F.lit(1)).alias("copies"),
    )


@query("transcript_parse_report", TRANSCRIPT + """
SELECT 'app' || (conv_id % 7) AS folder,
  sum(CASE role WHEN 'assistant' THEN 3 ELSE 1 END)::BIGINT AS records,
  count(*) FILTER (turn = 0)::BIGINT AS parse_errors FROM c GROUP BY 1""")
def _(spark, sf):
    parsed = tr.parse(tr.read_lines(spark, wt.directory(spark, sf), pattern=wt.PATTERN))
    report = tr.parse_report(parsed)
    folder = F.regexp_extract("source_path", r"folder=([^/]+)/", 1)
    return report.groupBy(folder.alias("folder")).agg(
        F.sum("records").alias("records"), F.sum("parse_errors").alias("parse_errors")
    )


@query("transcript_drift", TRANSCRIPT + """, n AS (
  SELECT sum(CASE role WHEN 'assistant' THEN 3 ELSE 1 END)::BIGINT AS r,
    2 * count(*) FILTER (role = 'assistant')::BIGINT AS a FROM c)
SELECT field, CASE WHEN field LIKE 'message%' THEN a ELSE r END::BIGINT AS applicable,
  CASE WHEN field LIKE 'message%' THEN a ELSE r END::BIGINT AS present, 1.0::DOUBLE AS coverage, 0::BIGINT AS warning
FROM n, (SELECT unnest(['timestamp','sessionId','uuid','cwd','version','message.model','message.usage']) AS field)""")
def _(spark, sf):
    return tr.drift_report(
        tr.parse(tr.read_lines(spark, wt.directory(spark, sf), pattern=wt.PATTERN))
    )


@query("transcript_sources", TRANSCRIPT + """
SELECT count(DISTINCT conv_id % 7)::BIGINT AS project_directories, '2.1.0' AS newest_version FROM c""")
def _(spark, sf):
    return tr.source_summary(
        tr.parse(tr.read_lines(spark, wt.directory(spark, sf), pattern=wt.PATTERN))
    ).select("project_directories", "newest_version")


@query("transcript_files")
def _(spark, sf):
    return tr.discover(spark, wt.directory(spark, sf), wt.PATTERN).select(
        F.regexp_extract("source_path", r"(folder=[^/]+)/", 1).alias("folder"), "file_size"
    )


@query("transcript_rewrites")
def _(spark, sf):
    heads = tr.file_heads(spark, wt.directory(spark, sf), pattern=wt.PATTERN)
    marks = heads.withColumn("file_size", F.col("file_size") - F.length("head_hash"))
    return tr.changed_files(heads, marks).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query("hook_events", """
SELECT h AS hook, CASE h WHEN 'SessionStart' THEN 'session_start' WHEN 'SessionEnd' THEN 'session_end'
  WHEN 'Notification' THEN 'notification' ELSE 'compaction' END AS event_type, sub::BIGINT AS is_subagent, count(*)::BIGINT AS events
FROM (SELECT ['SessionStart','SessionEnd','PreCompact','PostCompact','Notification','PreToolUse','Stop'][event_id % 7 + 1] AS h,
  event_id % 3 = 0 AS sub FROM events) WHERE h NOT IN ('PreToolUse', 'Stop') GROUP BY ALL""")
def _(spark, sf):
    i = F.col("event_id")
    hooks = ("SessionStart", "SessionEnd", "PreCompact", "PostCompact", "Notification",
             "PreToolUse", "Stop")
    payloads = v.load(spark, sf, "events").select(
        v.pick(hooks, i % 7).alias("hook_event_name"),
        F.col("user_id").cast("string").alias("session_id"),
        F.lit("/home/dev").alias("cwd"), F.lit(None).cast("string").alias("model"),
        F.when(i % 3 == 0, F.lit("agent-1")).alias("agent_id"),
        F.lit(None).cast("string").alias("agent_type"), F.lit("x").alias("reason"),
        F.lit(None).cast("string").alias("permission_mode"),
        F.concat(F.lit("t"), i.cast("string")).alias("received_at"),
    )
    mapped = tr.map_hooks(payloads)
    return mapped.groupBy(
        F.get_json_object("metadata", "$.hookEvent").alias("hook"), "event_type", "is_subagent"
    ).agg(F.count(F.lit(1)).alias("events"))


@query("manifest_technologies", """
SELECT '/srv/m' || (doc_id % 50) AS project_path, array_to_string(list_sort(list_distinct(flatten(list(
  CASE WHEN doc_id % 3 = 0 THEN ['React', 'Vitest'] WHEN doc_id % 3 = 1 THEN ['Django', 'Pytest']
  ELSE ['Go'] END)))), '|') AS technologies FROM documents GROUP BY 1""")
def _(spark, sf):
    i = F.col("doc_id")
    body = (
        F.when(i % 3 == 0, '{"dependencies": {"react" : "18", "vitest": "2"}}')
        .when(i % 3 == 1, "requests\nDjango==5\npytest")
        .otherwise("module example.org/x\n\ngo 1.22")
    )
    files = v.load(spark, sf, "documents").select(
        F.concat(F.lit("/srv/m"), (i % 50).cast("string")).alias("project_path"),
        body.alias("content"),
    )
    return manifests.project_profiles(files).select("project_path", "technologies")


