"""Questions about usage: totals, breakdowns, sessions, projects, prompts, rollups, findings."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from usagelake.contract import EventFilters, Settings
from usagelake.functions import classify as cl
from usagelake.functions import measures
from usagelake.functions import text as tx
from usagelake.functions.ids import is_real_model
from usagelake.operators import active, enrichment, feed, filters, lookups, maintenance as mt
from usagelake.operators import projects as pj, prompts as pr, rollups as ru, sessions as ss
from usagelake.operators import totals as tt
from usagelake.plans import insights, overview as ov
from usagelake.plans.ranges import DaySpan, ResolvedRange
from usagelake.plans.scope import make_scope
from usagelake.sources import export as ex
from usagelake.sources import push
from workload import views as v
from workload.oracle_base import (
    ALL, DIM, IDLE, LOG, NOTES, TAIL, TEXT, active as act, gaps, q, with_,
)
from workload.registry import flat, query

EV, PRS, NTS, DMS, EVERY = (with_(*p) for p in (LOG, TEXT, NOTES, DIM, ALL))
SPAN = DaySpan(dt.date(2024, 1, 16), dt.date(2024, 1, 30))
WEEK = DaySpan(dt.date(2024, 1, 20), dt.date(2024, 1, 26))
AS_OF = dt.datetime(2024, 1, 30, 12, tzinfo=dt.timezone.utc)
SETTINGS = Settings(timezone="UTC", idle_ms=IDLE, as_of=AS_OF)
F_SPAN = EventFilters(from_day="2024-01-16", to_day="2024-01-30")
IN_SPAN = "local_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-30'"
IN_PREV = "local_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15'"

MACHINE = (
    r"(?is)^(<task-notification|<system-reminder|<ide.|<command-|<local-command"
    r"|\[Request interrupted|Caveat: The messages below were generated"
    r"|This session is being continued from a previous)"
)


def scope(span=SPAN, f: EventFilters | None = None):
    return make_scope(ResolvedRange("custom", "UTC", span, span.previous()), SETTINGS, f)


def counts(prefix: str = "") -> str:
    return f"""count(*)::BIGINT AS events, count(*) FILTER (event_type = 'prompt')::BIGINT AS prompts,
  count(*) FILTER (event_type = 'response')::BIGINT AS responses,
  count(*) FILTER (event_type = 'tool_call')::BIGINT AS tool_calls,
  count(DISTINCT session_id)::BIGINT AS sessions, count(DISTINCT project_id)::BIGINT AS projects,
  {tokens()}, round(sum(cost), 6) AS estimated_cost_usd"""


def tokens(columns=("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")):
    return ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in columns)


P = "count(*) FILTER (event_type = 'prompt')::BIGINT"


# ---- active time and totals -------------------------------------------------------------------


@query("daily_usage", EV + f""", {gaps()}, a AS (
  SELECT local_date, sum(gap)::BIGINT + count(DISTINCT session_id) * {TAIL} AS active_ms FROM g GROUP BY 1)
SELECT local_date::VARCHAR AS bucket, {P} AS prompts, count(DISTINCT session_id)::BIGINT AS sessions,
  coalesce(max(a.active_ms), 0)::BIGINT AS active_ms, {tokens(('input_tokens', 'output_tokens'))},
  round(sum(cost), 6) AS estimated_cost_usd
FROM ev LEFT JOIN a USING (local_date) GROUP BY 1""")
def _(spark, sf):
    return tt.timeseries(v.tables(spark, sf).events, "day", IDLE)


@query("totals", EV + f""", {gaps()}
SELECT {counts()}, (SELECT {act()} FROM g) AS active_ms FROM ev""")
def _(spark, sf):
    return tt.totals(v.tables(spark, sf).events, (), IDLE)


@query("active_time_five_minutes", EV + f""", {gaps(idle=300000)}
SELECT {act()} AS active_ms, count(DISTINCT session_id || '|' || local_date)::BIGINT AS session_days FROM g""")
def _(spark, sf):
    return active.active_time(v.tables(spark, sf).events)


@query("active_time_by_day", EV + f""", {gaps()}
SELECT local_date::VARCHAR AS local_date, {act()} AS active_ms, count(DISTINCT session_id)::BIGINT AS sessions
FROM g GROUP BY 1""")
def _(spark, sf):
    return active.active_by_day(v.tables(spark, sf).events, IDLE)


@query("active_time_in_slice", EV + f""", s AS (
  SELECT * FROM ev WHERE {IN_SPAN} AND event_type IN ('prompt', 'response')), {gaps('s', keys='provider_id, session_id')}
SELECT provider_id, {act()} AS active_ms, count(DISTINCT session_id || '|' || local_date)::BIGINT AS session_days
FROM g GROUP BY 1""")
def _(spark, sf):
    sliced = filters.apply_filters(v.tables(spark, sf), F_SPAN).where(
        F.col("event_type").isin("prompt", "response")
    )
    return active.active_time(sliced, ["provider_id"], ["provider_id"], IDLE)


for _grain, _key in (
    ("hour", "local_date::VARCHAR || 'T' || lpad(local_hour::VARCHAR, 2, '0')"),
    ("day", "local_date::VARCHAR"), ("week", "strftime(local_date, '%Y-W%W')"),
):

    @query(f"buckets_by_{_grain}", EV + f"""
SELECT {_key} AS bucket, {P} AS prompts, count(DISTINCT session_id)::BIGINT AS sessions,
  {tokens(('input_tokens', 'output_tokens'))}, round(sum(cost), 6) AS estimated_cost_usd FROM ev GROUP BY 1""")
    def _(spark, sf, grain=_grain):
        return tt.buckets(v.tables(spark, sf).events, grain)


@query("first_event", EV + "SELECT min(ts_ms) AS first_event_ms FROM ev")
def _(spark, sf):
    return tt.first_event(v.tables(spark, sf).events)


@query("provider_summary", DMS + """
SELECT p.provider_id, p.name, p.enabled::BIGINT AS enabled, CASE WHEN p.enabled THEN 'connected' ELSE 'paused' END AS status,
  count(ev.event_id)::BIGINT AS event_count, max(ts_ms) AS last_event_ms
FROM providers_d p LEFT JOIN ev USING (provider_id) GROUP BY ALL""")
def _(spark, sf):
    return tt.provider_summary(v.tables(spark, sf))


@query("provider_last_event", DMS + """
SELECT p.provider_id, max(ts_ms) AS last_event_ms FROM providers_d p JOIN ev USING (provider_id) GROUP BY 1""")
def _(spark, sf):
    t = v.tables(spark, sf)
    early = t.events.where(F.col("event_type") == "prompt")
    once = tt.touch_last_event(t.providers, t.events)
    return tt.touch_last_event(once, early).select("provider_id", "last_event_ms")


# ---- filters ----------------------------------------------------------------------------------


@query("filter_own_columns", EV + f"""
SELECT event_id FROM ev WHERE {IN_SPAN} AND provider_id = 'beta_ide' AND event_type = 'response'
  AND model = 'claude-opus-4-8'""")
def _(spark, sf):
    f = F_SPAN.but(provider_id="beta_ide", event_type="response", model="claude-opus-4-8")
    return filters.apply_filters(v.tables(spark, sf), f).select("event_id")


@query("filter_instants", EV + """
SELECT event_id FROM ev WHERE ts_ms BETWEEN 1705276800000 AND 1705881600000""")
def _(spark, sf):
    utc = dt.timezone.utc
    f = EventFilters(from_ts=dt.datetime(2024, 1, 15, tzinfo=utc),
                     to_ts=dt.datetime(2024, 1, 22, tzinfo=utc))
    return filters.apply_filters(v.tables(spark, sf), f).select("event_id")


@query("filter_typed_by_person", PRS + f"""
SELECT event_type, count(*)::BIGINT AS events FROM ev WHERE NOT is_subagent
  AND event_id NOT IN (SELECT event_id FROM prompts_d WHERE regexp_matches(preview, {q(MACHINE)}))
GROUP BY 1""")
def _(spark, sf):
    typed = filters.apply_filters(v.tables(spark, sf), EventFilters(include_subagents=False))
    return typed.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@query("filter_category_and_technology", NTS + """
SELECT event_id FROM ev WHERE event_id IN (SELECT event_id FROM note WHERE category = 'DevOps')
  AND event_id IN (SELECT event_id FROM tech_d WHERE technology = 'Docker')""")
def _(spark, sf):
    f = EventFilters(category="DevOps", technology="Docker")
    return filters.apply_filters(v.tables(spark, sf), f).select("event_id")


# ---- breakdowns -------------------------------------------------------------------------------


@query("by_provider", DMS + f"""
SELECT ev.provider_id AS key, coalesce(max(p.name), ev.provider_id) AS name, {P} AS count,
  CASE WHEN sum({P}) OVER () > 0 THEN floor({P}::DOUBLE / sum({P}) OVER () * 1000.0 + 0.5) / 10.0 ELSE 0.0 END::DOUBLE AS share
FROM ev LEFT JOIN providers_d p USING (provider_id) GROUP BY 1""")
def _(spark, sf):
    return tt.with_share(tt.by_provider(v.tables(spark, sf)))


BY_CATEGORY = """
SELECT coalesce(category, 'Other') AS key, count(*)::BIGINT AS count,
  round(coalesce(avg(confidence), 0), 6) AS avg_confidence
FROM ev LEFT JOIN note USING (event_id) WHERE event_type = 'prompt'"""


@query("by_category", NTS + BY_CATEGORY + " GROUP BY 1")
def _(spark, sf):
    return tt.by_category(v.tables(spark, sf))


@query("categories_over_periods", NTS + f""", c AS ({BY_CATEGORY} AND ev.{IN_SPAN} GROUP BY 1),
p AS ({BY_CATEGORY} AND ev.{IN_PREV} GROUP BY 1)
SELECT c.key AS category, c.count AS prompts,
  (floor(c.count::DOUBLE / sum(c.count) OVER () * 1000.0 + 0.5) / 10.0)::DOUBLE AS share,
  round((floor(c.avg_confidence * 100 + 0.5) / 100)::DOUBLE, 6) AS avg_confidence,
  (floor(coalesce(p.count, 0)::DOUBLE / (SELECT sum(count) FROM p) * 1000.0 + 0.5) / 10.0)::DOUBLE AS previous_share
FROM c LEFT JOIN p USING (key)""")
def _(spark, sf):
    t, s = v.tables(spark, sf), scope()
    return tt.categories(tt.by_category(t, s.filters), tt.by_category(t, s.previous))


@query("by_project", DMS + """
SELECT ev.project_id AS key, coalesce(max(p.name), 'Unknown') AS name, count(*)::BIGINT AS count
FROM ev LEFT JOIN projects_d p USING (project_id) WHERE event_type = 'prompt' AND ev.project_id IS NOT NULL
GROUP BY 1 ORDER BY count DESC, key LIMIT 20""")
def _(spark, sf):
    return tt.by_project(v.tables(spark, sf), limit=20)


@query("by_technology", NTS + """
SELECT technology AS key, count(*)::BIGINT AS count FROM tech_d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def _(spark, sf):
    return tt.by_technology(v.tables(spark, sf), limit=15)


@query("by_context", NTS + "SELECT context AS key, count(*)::BIGINT AS count FROM ctx_d GROUP BY 1")
def _(spark, sf):
    return tt.by_context(v.tables(spark, sf))


@query("by_context_of_technology", NTS + """
SELECT context AS key, count(*)::BIGINT AS count FROM ctx_d
WHERE event_id IN (SELECT event_id FROM tech_d WHERE technology = 'Python') GROUP BY 1""")
def _(spark, sf):
    return tt.by_context(v.tables(spark, sf), technology="Python")


@query("technology_contexts", NTS + """, t AS (
  SELECT technology, count(*)::BIGINT AS n FROM tech_d GROUP BY 1
), x AS (
  SELECT technology, context, count(*) AS n, row_number() OVER (PARTITION BY technology ORDER BY count(*) DESC, context) AS place
  FROM tech_d JOIN ctx_d USING (event_id) GROUP BY 1, 2)
SELECT technology, t.n AS prompts, (floor(t.n::DOUBLE / sum(t.n) OVER () * 1000.0 + 0.5) / 10.0)::DOUBLE AS share,
  coalesce((SELECT string_agg(context || ':' || x.n, ',' ORDER BY place) FROM x WHERE x.technology = t.technology AND place <= 4), '') AS areas
FROM t""")
def _(spark, sf):
    out = tt.technology_contexts(v.tables(spark, sf))
    areas = F.transform("contexts", lambda c: F.concat_ws(":", c["context"], c["count"].cast("string")))
    return out.withColumn("areas", F.array_join(areas, ",")).drop("contexts")


MODEL_COUNTS = f"""model, max(model_family) AS model_family, count(*)::BIGINT AS events, {P} AS prompts,
  count(*) FILTER (event_type = 'response')::BIGINT AS responses, {tokens()}, round(sum(cost), 6) AS estimated_cost_usd"""


@query("by_model", EV + f"SELECT {MODEL_COUNTS} FROM ev WHERE model IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return tt.by_model(v.tables(spark, sf).events)


@query("models_with_share", EV + f"""
SELECT *, (floor(events::DOUBLE / sum(events) OVER () * 1000.0 + 0.5) / 10.0)::DOUBLE AS share
FROM (SELECT {MODEL_COUNTS} FROM ev WHERE model IS NOT NULL AND NOT starts_with(model, '<') GROUP BY 1)""")
def _(spark, sf):
    return tt.models(v.tables(spark, sf).events)


@query("active_hours", EV + """
SELECT h AS hour, coalesce(n, 0)::BIGINT AS prompts FROM range(24) r(h) LEFT JOIN (
  SELECT local_hour AS h, count(*) AS n FROM ev WHERE event_type = 'prompt' GROUP BY 1) USING (h)""")
def _(spark, sf):
    f = EventFilters(event_type="prompt")
    return tt.active_hours(filters.apply_filters(v.tables(spark, sf), f))


@query("active_weekdays", EV + """
SELECT w AS weekday, coalesce(n, 0)::BIGINT AS prompts FROM range(7) r(w) LEFT JOIN (
  SELECT local_weekday AS w, count(*) AS n FROM ev WHERE event_type = 'prompt' GROUP BY 1) USING (w)""")
def _(spark, sf):
    f = EventFilters(event_type="prompt")
    return tt.active_weekdays(filters.apply_filters(v.tables(spark, sf), f))


@query("peak_window", EV + """, h AS (
  SELECT r.h, coalesce(n, 0) AS n FROM range(24) r(h) LEFT JOIN (
    SELECT local_hour AS h, count(*) AS n FROM ev WHERE event_type = 'prompt' GROUP BY 1) USING (h))
SELECT a.h AS from_hour, ((a.h + 3) % 24)::BIGINT AS to_hour, sum(b.n)::BIGINT AS prompts
FROM h a JOIN h b ON (b.h - a.h + 24) % 24 < 3 GROUP BY 1 ORDER BY prompts DESC, from_hour LIMIT 1""")
def _(spark, sf):
    t = v.tables(spark, sf)
    return tt.peak_window(tt.active_hours(t.events.where(F.col("event_type") == "prompt")))


@query("busiest_bucket", EV + f"""
SELECT local_date::VARCHAR AS bucket, {P} AS prompts FROM ev GROUP BY 1 HAVING prompts > 0 ORDER BY prompts DESC, bucket LIMIT 1""")
def _(spark, sf):
    return tt.busiest_bucket(tt.buckets(v.tables(spark, sf).events, "day"))


@query("cache_reuse", EV + """
SELECT provider_id, round((coalesce(sum(cache_read_tokens), 0) / nullif(coalesce(sum(input_tokens), 0) + coalesce(sum(cache_read_tokens), 0)
  + coalesce(sum(cache_write_tokens), 0), 0))::DOUBLE, 6) AS cache_reuse FROM ev GROUP BY 1""")
def _(spark, sf):
    t = v.tables(spark, sf)
    rows = tt.counters(t.events, ["provider_id"])
    return rows.select("provider_id", measures.cache_reuse(
        F.col("input_tokens"), F.col("cache_read_tokens"), F.col("cache_write_tokens")
    ).alias("cache_reuse"))


@query("daily_changes", EV + f""", d AS (SELECT local_date, {P} AS n, sum(cost) AS c FROM ev GROUP BY 1)
SELECT a.local_date::VARCHAR AS day, CASE WHEN b.n = 0 THEN CASE WHEN a.n = 0 THEN 0.0 END
  ELSE floor((a.n - b.n)::DOUBLE / b.n * 1000.0 + 0.5) / 10.0 END::DOUBLE AS change,
  CASE WHEN b.n > 0 THEN floor(a.n::DOUBLE / b.n * 100.0 + 0.5) / 100.0 ELSE 0.0 END::DOUBLE AS ratio,
  (a.c IS NULL OR b.c IS NULL)::BIGINT AS cost_unknown
FROM d a JOIN d b ON b.local_date = a.local_date - 1""")
def _(spark, sf):
    d = tt.buckets(v.tables(spark, sf).events, "day").select(
        F.col("bucket").cast("date").alias("day"), F.col("prompts").alias("n"),
        F.col("estimated_cost_usd").alias("c"),
    )
    before = d.select(F.date_add("day", 1).alias("day"), F.col("n").alias("m"),
                      F.col("c").alias("k"))
    return d.join(before, "day").select(
        "day", measures.change_pct(F.col("n"), F.col("m")).alias("change"),
        measures.ratio(F.col("n"), F.col("m")).alias("ratio"),
        measures.cost_change_pct(
            F.when(F.col("c").isNotNull(), F.lit(2.0)), F.when(F.col("k").isNotNull(), F.lit(1.0))
        ).isNull().alias("cost_unknown"),
    )


@query("real_models", EV + """
SELECT DISTINCT model FROM ev WHERE model IS NOT NULL AND model <> '' AND model NOT LIKE '<%'""")
def _(spark, sf):
    return v.tables(spark, sf).events.where(is_real_model(F.col("model"))).select(
        "model").distinct()


@query("subscription_value", EV + """
SELECT provider_id, 20.0 AS monthly_usd, round(sum(cost), 6) AS estimated_cost_usd,
  (floor(20.0 * 15 / 30.437::DOUBLE * 100.0 + 0.5) / 100.0)::DOUBLE AS period_usd,
  round(sum(cost) / (floor(20.0 * 15 / 30.437::DOUBLE * 100.0 + 0.5) / 100.0), 6) AS leverage
FROM ev GROUP BY 1""".replace("20.0 AS monthly_usd", "20.0::DOUBLE AS monthly_usd"))
def _(spark, sf):
    t = v.tables(spark, sf)
    plans = t.events.select("provider_id").distinct().withColumn("monthly_usd", F.lit(20.0))
    spent = t.events.groupBy("provider_id").agg(tt.cost_sum())
    return ov.subscription_value(spent, plans, 15)


# ---- sessions ---------------------------------------------------------------------------------

LIFE = f""", {gaps()}, a AS (SELECT session_id, {act()} AS active_ms FROM g GROUP BY 1), m AS (
  SELECT session_id, arg_min(model, {{'n': -n, 'm': model}}) AS primary_model FROM (
    SELECT session_id, model, count(*) AS n FROM ev WHERE model IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"""


@query("session_metrics", EV + LIFE + f"""
SELECT session_id, max(provider_id) AS provider_id, {P} AS prompt_count,
  count(*) FILTER (event_type = 'response')::BIGINT AS response_count, count(*) FILTER (event_type = 'tool_call')::BIGINT AS tool_count,
  {tokens()}, round(sum(cost), 6) AS estimated_cost_usd, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms,
  arg_min(project_id, {{'t': ts_ms, 'i': event_id}}) FILTER (project_id IS NOT NULL) AS project_id,
  max(primary_model) AS primary_model, max(active_ms) AS active_ms, max(ts_ms) - min(ts_ms) AS duration_ms
FROM ev LEFT JOIN m USING (session_id) JOIN a USING (session_id) GROUP BY 1""")
def _(spark, sf):
    return ss.session_metrics(v.tables(spark, sf).events, IDLE)


@query("session_boundaries", EV + """
SELECT session_id, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms,
  arg_min(model, {'t': ts_ms, 'i': event_id}) FILTER (model IS NOT NULL) AS primary_model,
  arg_min(working_directory, {'t': ts_ms, 'i': event_id}) FILTER (working_directory IS NOT NULL) AS working_directory
FROM ev WHERE session_id IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return ss.session_boundaries(v.tables(spark, sf).events).select(
        "session_id", "started_ms", "ended_ms", "primary_model", "working_directory"
    )


SESSION_LIST = f""", s AS (SELECT * FROM ev WHERE {IN_SPAN} AND session_id IS NOT NULL), {gaps('s')},
a AS (SELECT session_id, {act()} AS active_ms FROM g GROUP BY 1),
life AS (SELECT session_id, min(ts_ms) AS session_started_ms FROM ev WHERE session_id IS NOT NULL GROUP BY 1),
listed AS (SELECT session_id, min(ts_ms) AS started_ms, max(ts_ms) AS ended_ms, max(session_started_ms) AS session_started_ms,
  max(ts_ms) - min(ts_ms) AS duration_ms, max(active_ms) AS active_ms, {P} AS prompt_count,
  count(*) FILTER (event_type = 'tool_call')::BIGINT AS tool_count, round(sum(cost), 6) AS estimated_cost_usd,
  (max(session_started_ms) < 1705363200000)::BIGINT AS started_before_range
FROM s JOIN a USING (session_id) JOIN life USING (session_id) GROUP BY 1)"""
LISTED = ("session_id", "started_ms", "ended_ms", "session_started_ms", "duration_ms", "active_ms",
          "prompt_count", "tool_count", "estimated_cost_usd", "started_before_range")
SPAN_START = dt.datetime(2024, 1, 16, tzinfo=dt.timezone.utc)


@query("session_list", EV + SESSION_LIST + "SELECT * FROM listed")
def _(spark, sf):
    return ss.session_list(v.tables(spark, sf), F_SPAN, IDLE, limit=None,
                           range_from=SPAN_START).select(*LISTED)


@query("session_list_page", EV + SESSION_LIST + """
SELECT session_id, ended_ms FROM listed WHERE (ended_ms, session_id) < (1706655000000, 'x')
ORDER BY ended_ms DESC, session_id DESC LIMIT 11""")
def _(spark, sf):
    return ss.session_list(v.tables(spark, sf), F_SPAN, IDLE, limit=10,
                           cursor=(1_706_655_000_000, "x")).select("session_id", "ended_ms")


@query("session_page_totals", EV + f""", s AS (SELECT * FROM ev WHERE {IN_SPAN}), {gaps('s')}
SELECT count(DISTINCT session_id)::BIGINT AS sessions, {P} AS prompts, (SELECT {act()} FROM g) AS active_ms,
  round(sum(cost), 6) AS estimated_cost_usd FROM s""")
def _(spark, sf):
    return ss.session_page_totals(filters.apply_filters(v.tables(spark, sf), F_SPAN), IDLE)


@query("session_categories", NTS + """
SELECT session_id, category, count(*)::BIGINT AS count FROM ev JOIN note USING (event_id)
WHERE session_id IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return ss.session_categories(v.tables(spark, sf))


ONE = "(SELECT substr(sha256('alpha-cli|s8'), 1, 24))"


def one_session() -> str:
    import hashlib

    return hashlib.sha256(b"alpha-cli|s8").hexdigest()[:24]


@query("session_timeline", NTS + f"""
SELECT ev.event_id, ev.ts_ms, event_type, coalesce(preview, tool_name, event_type) AS label, model, tool_name, category,
  is_subagent::BIGINT AS is_subagent
FROM ev LEFT JOIN note USING (event_id) LEFT JOIN prompts_d p USING (event_id) WHERE session_id = {ONE}
ORDER BY ev.ts_ms, ev.event_id""")
def _(spark, sf):
    return ss.session_timeline(v.tables(spark, sf), one_session())


@query("session_detail", EV + LIFE + f"""
SELECT session_id, {P} AS prompt_count, max(primary_model) AS primary_model, max(active_ms) AS active_ms
FROM ev JOIN m USING (session_id) JOIN a USING (session_id) WHERE session_id = {ONE} GROUP BY 1""")
def _(spark, sf):
    return ss.session_detail(v.tables(spark, sf), one_session(), IDLE)["summary"].select(
        "session_id", "prompt_count", "primary_model", "active_ms"
    )


@query("session_day_sections", EV + LIFE + f""", s AS (
  SELECT session_id, min(ts_ms) AS started, {P} AS n, max(active_ms) AS active_ms FROM ev JOIN a USING (session_id) GROUP BY 1)
SELECT (DATE '1970-01-01' + (started // 86400000)::INT)::VARCHAR AS day, count(*)::BIGINT AS sessions,
  sum(n)::BIGINT AS prompts, sum(active_ms)::BIGINT AS active_ms FROM s GROUP BY 1""")
def _(spark, sf):
    return ss.day_sections(ss.session_metrics(v.tables(spark, sf).events, IDLE))


@query("sessions_with_prompts", EV + """
SELECT DISTINCT session_id FROM ev s WHERE session_id IS NOT NULL
  AND session_id IN (SELECT session_id FROM ev WHERE event_type = 'prompt' AND model IS NULL)""")
def _(spark, sf):
    t = v.tables(spark, sf)
    every = ss.session_boundaries(t.events)
    return ss.prune_empty(every, t.events.where(F.col("event_type") == "prompt")).select(
        "session_id"
    )


# ---- projects ---------------------------------------------------------------------------------

DETAIL = f""", s AS (SELECT * FROM ev WHERE project_id IS NOT NULL), {gaps('s', keys='project_id, session_id')},
a AS (SELECT project_id, {act()} AS active_ms FROM g GROUP BY 1),
usage AS (SELECT s.project_id, max(p.name) AS name, max(p.path) AS path, {P} AS prompts,
  count(DISTINCT session_id)::BIGINT AS sessions, coalesce(max(active_ms), 0)::BIGINT AS active_ms, max(ts_ms) AS last_activity_ms
FROM s JOIN projects_d p USING (project_id) LEFT JOIN a USING (project_id) GROUP BY 1)"""
USAGE = ("project_id", "name", "path", "prompts", "sessions", "active_ms", "last_activity_ms")


@query("project_details", DMS + DETAIL + "SELECT * FROM usage")
def _(spark, sf):
    return pj.project_details(v.tables(spark, sf), None, None, IDLE).select(*USAGE)


for _dim, _src in (
    ("category", "ev JOIN note USING (event_id)"),
    ("technology", "ev JOIN tech_d USING (event_id)"),
    ("model", "(SELECT project_id, model FROM ev WHERE model IS NOT NULL)"),
):

    @query(f"top_{_dim}_per_project", (EV if _dim == "model" else NTS) + f"""
SELECT project_id, {_dim} AS key, count(*)::BIGINT AS count,
  row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, {_dim})::BIGINT AS place
FROM {_src} WHERE project_id IS NOT NULL GROUP BY 1, 2 QUALIFY place <= 5""")
    def _(spark, sf, dim=_dim):
        return pj.top_per_project(v.tables(spark, sf), dim)


PARENTS = """, pa AS (
  SELECT c.project_id, arg_max(p.project_id, length(p.path)) AS parent_id, count(*) AS depth
  FROM usage c JOIN usage p ON starts_with(c.path, p.path || '/') GROUP BY 1)"""


@query("project_parents", DMS + DETAIL + PARENTS + """
SELECT project_id, parent_id, depth::BIGINT AS depth FROM pa""")
def _(spark, sf):
    return pj.nearest_parents(v.tables(spark, sf).projects).select(
        "project_id", "parent_id", "depth"
    )


FOLDED = PARENTS + """, o AS (
  SELECT u.*, CASE WHEN coalesce(depth, 0) % 2 = 1 THEN parent_id ELSE u.project_id END AS owner
  FROM usage u LEFT JOIN pa USING (project_id)), folded AS (
SELECT owner AS project_id, max(path) FILTER (owner = project_id) AS path, sum(prompts)::BIGINT AS prompts, sum(sessions)::BIGINT AS sessions,
  sum(active_ms)::BIGINT AS active_ms, max(last_activity_ms) AS last_activity_ms, count(*) FILTER (owner <> project_id)::BIGINT AS children
FROM o GROUP BY 1)"""


@query("folded_projects", DMS + DETAIL + FOLDED + "SELECT * FROM folded")
def _(spark, sf):
    usage = pj.project_details(v.tables(spark, sf), None, None, IDLE)
    return pj.fold_subdirectories(usage).drop("name")


@query("sorted_projects", DMS + DETAIL + """
SELECT project_id, sessions FROM usage WHERE prompts > 0""")
def _(spark, sf):
    usage = pj.project_details(v.tables(spark, sf), None, None, IDLE)
    return pj.sorted_projects(usage, "sessions").select("project_id", "sessions")


# ---- prompts ----------------------------------------------------------------------------------


@query("repeated_prompts", PRS + """
SELECT normalized_hash AS fingerprint, max(preview) AS text, count(*)::BIGINT AS count, max(ts_ms) AS last_seen_ms
FROM prompts_d WHERE char_length > 12 GROUP BY 1 HAVING count(*) > 1""")
def _(spark, sf):
    return pr.repeated(v.tables(spark, sf))


@query("newest_events", EV + """
SELECT provider_id, max_by(event_id, (ts_ms, event_id)) AS event_id, max(ts_ms) AS ts_ms FROM ev GROUP BY 1""")
def _(spark, sf):
    return lookups.newest(v.tables(spark, sf).events)


@query("sessions_without_start", EV + """
SELECT session_id FROM ev WHERE session_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (event_type = 'session_start') = 0""")
def _(spark, sf):
    return lookups.sessions_without_start(v.tables(spark, sf).events)


@query("session_by_external_id", EV + f"""
SELECT session_id, provider_id, count(*)::BIGINT AS events FROM ev WHERE session_id = {ONE} GROUP BY ALL""")
def _(spark, sf):
    return lookups.session_of(v.tables(spark, sf), "alpha-cli", "s8")


@query("events_present", EV + """
SELECT event_id, true::BIGINT AS present FROM ev WHERE event_type = 'prompt' UNION ALL SELECT 'not-there', 0::BIGINT""")
def _(spark, sf):
    events = v.tables(spark, sf).events
    keys = events.where(F.col("event_type") == "prompt").select("event_id")
    return lookups.present(events, keys.unionByName(keys.limit(1).select(F.lit("not-there").alias("event_id"))))


@query("prompt_length", PRS + """
SELECT round(avg(char_length), 6) AS avg_chars, round(avg(word_length), 6) AS avg_words, count(*)::BIGINT AS total FROM prompts_d""")
def _(spark, sf):
    return pr.length_stats(v.tables(spark, sf))


@query("themes", PRS + f"""
SELECT term, count(*)::BIGINT AS count FROM (
  SELECT unnest(list_distinct(string_split(stored_norm, ' '))) AS term FROM prompts_d WHERE text IS NOT NULL)
WHERE length(term) >= 4 AND term NOT IN ({', '.join(q(w) for w in pr.STOP_WORDS)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def _(spark, sf):
    return pr.themes(pr.stored_texts(v.tables(spark, sf)))


FOLDS = "' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query("prompt_search", PRS + f"""
SELECT event_id, ts_ms FROM prompts_d WHERE contains({FOLDS}, ' deplo') AND contains({FOLDS}, ' kube')
ORDER BY ts_ms DESC, event_id DESC LIMIT 51""")
def _(spark, sf):
    return pr.search(v.tables(spark, sf), query="KUBE deplo!").select("event_id", "ts_ms")


@query("prompt_search_page", PRS + f"""
SELECT event_id, ts_ms FROM prompts_d WHERE contains({FOLDS}, ' etio') AND (ts_ms, event_id) < (1705000000000, 'm')
ORDER BY ts_ms DESC, event_id DESC LIMIT 26""")
def _(spark, sf):
    return pr.search(v.tables(spark, sf), query="étio", limit=25,
                     cursor=(1_705_000_000_000, "m")).select("event_id", "ts_ms")


@query("prompt_search_index", PRS + f"""
SELECT event_id FROM prompts_d WHERE contains({FOLDS}, ' test') AND contains({FOLDS}, ' py')""")
def _(spark, sf):
    return pr.search_index(pr.token_index(v.tables(spark, sf)), "test py")


@query("prompt_search_by_terms", PRS + f"""
SELECT event_id, ts_ms FROM prompts_d WHERE contains({FOLDS}, ' the') AND contains({FOLDS}, ' re')
  AND local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' ORDER BY ts_ms DESC, event_id DESC LIMIT 51""")
def _(spark, sf):
    t = v.tables(spark, sf)
    days = EventFilters(from_day=dt.date(2024, 1, 5), to_day=dt.date(2024, 1, 20))
    return pr.search(t, days, "thé re", index=pr.term_rows(t.prompts)).select("event_id", "ts_ms")


@query("prompt_matches", PRS + f"""
SELECT local_date::VARCHAR AS local_date, count(*)::BIGINT AS prompts FROM prompts_d WHERE contains({FOLDS}, ' the') AND contains({FOLDS}, ' re') GROUP BY 1""")
def _(spark, sf):
    p = v.tables(spark, sf).prompts
    return p.where(pr.matches(F.col("text"), "thé re")).groupBy("local_date").agg(
        F.count(F.lit(1)).alias("prompts")
    )


@query("prompt_details", NTS + """, x AS (
  SELECT event_id, array_to_string(list_sort(list(DISTINCT technology)), '|') AS technologies FROM tech_d GROUP BY 1), y AS (
  SELECT event_id, array_to_string(list_sort(list(DISTINCT context)), '|') AS contexts FROM ctx_d GROUP BY 1)
SELECT event_id, category, round(confidence, 6) AS category_confidence, sha256(text) AS text_hash,
  coalesce(technologies, '') AS technologies, coalesce(contexts, '') AS contexts
FROM prompts_d JOIN note USING (event_id) LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id)""")
def _(spark, sf):
    t = v.tables(spark, sf)
    return pr.details(t, t.events).select(
        "event_id", "category", "category_confidence", F.sha2("text", 256).alias("text_hash"),
        "technologies", "contexts",
    )


# ---- enrichment -------------------------------------------------------------------------------


@query("intent_scores", NTS + """
SELECT event_id, e.category, -e.neg::BIGINT AS score FROM (SELECT event_id, unnest(s) AS e FROM note)""")
def _(spark, sf):
    t = v.tables(spark, sf)
    due = enrichment.pending(t)
    scores = cl.intent_scores(tx.normalized_text(F.coalesce("text", F.lit(""))),
                              F.col("tool_names"))
    return due.where(F.col("text").isNotNull()).select("event_id", F.explode(scores).alias("e")).select(
        "event_id", "e.category", "e.score"
    )


@query("classifications", NTS + "SELECT event_id, category, round(confidence, 6) AS confidence FROM note")
def _(spark, sf):
    return v.tables(spark, sf).classifications.select("event_id", "category", "confidence")


@query("technologies", NTS + "SELECT event_id, technology, round(confidence, 6) AS confidence FROM tech_d")
def _(spark, sf):
    return v.tables(spark, sf).technologies.select("event_id", "technology", "confidence")


@query("contexts", NTS + "SELECT event_id, context, round(confidence, 6) AS confidence FROM ctx_d")
def _(spark, sf):
    return v.tables(spark, sf).contexts.select("event_id", "context", "confidence")


@query("pending_enrichment", EV + """
SELECT count(*)::BIGINT AS pending FROM ev WHERE event_type = 'prompt'""")
def _(spark, sf):
    return enrichment.pending_count(v.tables(spark, sf).events)


@query("user_overrides", NTS + """
SELECT event_id, CASE WHEN local_date = DATE '2024-01-10' THEN 'Writing' ELSE category END AS category,
  round(CASE WHEN local_date = DATE '2024-01-10' THEN 1.0 ELSE confidence END::DOUBLE, 6) AS confidence,
  CASE WHEN local_date = DATE '2024-01-10' THEN 'user' ELSE 'heuristic' END AS source FROM note""")
def _(spark, sf):
    t = v.tables(spark, sf)
    chosen = t.prompts.where(F.col("local_date") == "2024-01-10").select(
        "event_id", F.lit("Writing").alias("category"),
        F.array(F.lit("Documentation")).alias("contexts"), F.lit(1).alias("classifier_version"),
    )
    overridden = enrichment.apply_overrides(t, chosen)
    # Running the classifier again must not undo what the person decided.
    again, _days = enrichment.enrich(overridden)
    return again.classifications.select("event_id", "category", "confidence", "source")


@query("classifier_confusion", NTS + """
SELECT CASE WHEN contains(pad, ' test ') THEN 'Testing' ELSE 'Other' END AS expected,
  category AS predicted, count(*)::BIGINT AS count
FROM (SELECT n0.pad, note.category FROM n0 JOIN note USING (event_id)) GROUP BY 1, 2""")
def _(spark, sf):
    t = v.tables(spark, sf)
    due = enrichment.pending(t).where(F.col("text").isNotNull())
    padded = F.concat(F.lit(" "), tx.normalized_text(F.col("text")), F.lit(" "))
    labelled = due.select(
        "text", "tool_names", F.when(F.contains(padded, F.lit(" test ")), "Testing").otherwise("Other")
        .alias("expected"),
    )
    return enrichment.confusion(labelled)


# ---- rollups ----------------------------------------------------------------------------------

ROLL = """, lab AS (SELECT ev.*, category, confidence FROM ev LEFT JOIN note USING (event_id)), roll AS (
  SELECT local_date AS day, provider_id, project_id, model, category, count(*) FILTER (event_type = 'prompt')::BIGINT AS prompts,
    count(*) FILTER (event_type = 'response')::BIGINT AS responses, count(*) FILTER (event_type = 'tool_call')::BIGINT AS tool_calls,
    count(*) FILTER (event_type NOT IN ('prompt', 'response', 'tool_call'))::BIGINT AS other_events,
    count(DISTINCT session_id)::BIGINT AS sessions, """ + tokens() + """, sum(cost) AS cost,
    coalesce(sum(confidence), 0) AS confidence_sum, count(confidence)::BIGINT AS confidences
  FROM lab GROUP BY 1, 2, 3, 4, 5)"""
ACTIVE = f""", {gaps()}, act AS (
  SELECT local_date AS day, provider_id, {act()} AS active_ms, count(DISTINCT session_id)::BIGINT AS sessions FROM g GROUP BY 1, 2)"""
IN_DAYS = "day BETWEEN DATE '2024-01-16' AND DATE '2024-01-30'"

_ROLLED: set[str] = set()


def rolled(spark, sf):
    """Rollups built from the log once and kept beside it, as the ingest job keeps them."""
    saved = v.store(spark, sf)
    if saved.root not in _ROLLED:
        t = v.tables(spark, sf)
        saved.write("daily_rollups", ru.daily_rollups(t))
        saved.write("daily_active", ru.daily_active(t.events, None, IDLE))
        _ROLLED.add(saved.root)
    return saved.read("daily_rollups"), saved.read("daily_active")


@query("daily_rollups", NTS + ROLL + """
SELECT day::VARCHAR AS day, provider_id, project_id, model, category, prompts, responses, tool_calls, other_events, sessions,
  input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, round(cost, 6) AS estimated_cost_usd,
  round(confidence_sum, 6) AS confidence_sum, confidences FROM roll""")
def _(spark, sf):
    return ru.daily_rollups(v.tables(spark, sf))


@query("daily_active", EV + ACTIVE + """
SELECT day::VARCHAR AS day, provider_id, active_ms, sessions FROM act""")
def _(spark, sf):
    return ru.daily_active(v.tables(spark, sf).events, None, IDLE)


@query("daily_active_of_touched_days", EV + ACTIVE + """
SELECT day::VARCHAR AS day, provider_id, active_ms, sessions FROM act
SEMI JOIN (SELECT DISTINCT local_date AS day, provider_id FROM ev WHERE event_type = 'tool_call' AND tool_name = 'Task') t USING (day, provider_id)""")
def _(spark, sf):
    t = v.tables(spark, sf)
    calls = t.tool_calls.where(F.col("tool_name") == "Task").select("local_date", "provider_id")
    return ru.daily_active(t.events, calls.distinct(), IDLE)


@query("rollup_rebuild_check", EV + "SELECT (count(*) > 0)::BIGINT AS needs_rebuild FROM ev")
def _(spark, sf):
    t = v.tables(spark, sf)
    roll, _active = rolled(spark, sf)
    return ru.needs_rebuild(t.events, roll.where(F.col("prompts") < 0))


@query("stale_rollups", EV + """
SELECT DISTINCT local_date::VARCHAR AS local_date, provider_id FROM ev
WHERE local_date >= DATE '2024-01-12' OR provider_id = 'chat-log'""")
def _(spark, sf):
    """Rollups of which the later days were built under another idle limit and one provider not at all."""
    t = v.tables(spark, sf)
    now, other = Settings().rollup_fingerprint(), Settings(idle_ms=1).rollup_fingerprint()
    built = rolled(spark, sf)[0].where("provider_id <> 'chat-log'").withColumn(
        "settings", F.when(F.col("day") < F.lit("2024-01-12").cast("date"), now).otherwise(other))
    return ru.stale_days(t.events, built, now)


@query("covered_days", EV + ACTIVE + "SELECT count(*)::BIGINT AS covered_days FROM act")
def _(spark, sf):
    return ru.covered_days(rolled(spark, sf)[1])


ROLL_TOTALS = f"""sum(prompts)::BIGINT AS prompts, sum(responses)::BIGINT AS responses, sum(tool_calls)::BIGINT AS tool_calls,
  sum(prompts + responses + tool_calls + other_events)::BIGINT AS events, {tokens()}, round(sum(cost), 6) AS estimated_cost_usd"""


@query("rollup_totals", NTS + ROLL + ACTIVE + f"""
SELECT {ROLL_TOTALS}, (SELECT sum(active_ms)::BIGINT FROM act WHERE {IN_DAYS}) AS active_ms FROM roll WHERE {IN_DAYS}""")
def _(spark, sf):
    return ru.rollup_totals(*rolled(spark, sf), F_SPAN)


@query("rollup_totals_of_category", NTS + ROLL + f"""
SELECT {ROLL_TOTALS}, NULL::BIGINT AS active_ms FROM roll WHERE {IN_DAYS} AND category = 'Debugging'""")
def _(spark, sf):
    return ru.rollup_totals(*rolled(spark, sf), F_SPAN.but(category="Debugging"))


@query("rollup_active_by_day", EV + ACTIVE + f"""
SELECT day::VARCHAR AS day, sum(active_ms)::BIGINT AS active_ms FROM act WHERE {IN_DAYS} GROUP BY 1""")
def _(spark, sf):
    return ru.rollup_active_by_day(rolled(spark, sf)[1], F_SPAN)


for _name, _weekly, _bucket in (
    ("rollup_buckets", False, "day::VARCHAR"),
    ("rollup_buckets_weekly", True, "strftime(day, '%Y-W%W')"),
):

    @query(_name, NTS + ROLL + ACTIVE + f"""
SELECT bucket, prompts, input_tokens, output_tokens, estimated_cost_usd, sessions FROM (
  SELECT {_bucket} AS bucket, sum(prompts)::BIGINT AS prompts, {tokens(('input_tokens', 'output_tokens'))}, round(sum(cost), 6) AS estimated_cost_usd
  FROM roll GROUP BY 1) JOIN (SELECT {_bucket} AS bucket, sum(sessions)::BIGINT AS sessions FROM act GROUP BY 1) USING (bucket)""")
    def _(spark, sf, weekly=_weekly):
        return ru.rollup_buckets(*rolled(spark, sf), EventFilters(), weekly)


for _dim in ru.DIMENSIONS:

    @query(f"rollup_by_{_dim}", NTS + ROLL + f"""
SELECT {_dim} AS key, sum(prompts)::BIGINT AS count FROM roll WHERE {IN_DAYS} AND {_dim} IS NOT NULL GROUP BY 1 HAVING sum(prompts) > 0""")
    def _(spark, sf, dim=_dim):
        return ru.rollup_by(rolled(spark, sf)[0], dim, F_SPAN, None, None).select("key", "count")


@query("rollup_models", NTS + ROLL + f"""
SELECT model AS key, sum(responses)::BIGINT AS count FROM roll WHERE {IN_DAYS} AND model IS NOT NULL GROUP BY 1 HAVING sum(responses) > 0""")
def _(spark, sf):
    return ru.rollup_models(rolled(spark, sf)[0], F_SPAN, None)


@query("rollup_categories", NTS + f"""
SELECT coalesce(category, 'Other') AS key, count(*)::BIGINT AS count, round(coalesce(avg(confidence), 0), 6) AS avg_confidence
FROM ev LEFT JOIN note USING (event_id) WHERE event_type = 'prompt' AND ev.{IN_SPAN} GROUP BY 1""")
def _(spark, sf):
    return ru.rollup_categories(rolled(spark, sf)[0], F_SPAN)


@query("rollup_distincts", EV + f"""
SELECT count(DISTINCT session_id)::BIGINT AS sessions, count(DISTINCT project_id)::BIGINT AS projects FROM ev WHERE {IN_SPAN}""")
def _(spark, sf):
    return ru.exact_distincts(v.tables(spark, sf), rolled(spark, sf)[0], F_SPAN)


@query("weekly_sessions", EV + f"""
SELECT strftime(local_date, '%Y-W%W') AS bucket, count(DISTINCT session_id)::BIGINT AS sessions FROM ev WHERE {IN_SPAN} GROUP BY 1""")
def _(spark, sf):
    return ru.weekly_sessions(v.tables(spark, sf).events, F_SPAN)


# ---- overview, findings, feed -----------------------------------------------------------------


def period_sql(name: str, where: str, active_days: str | None = None) -> str:
    spent = f"SELECT {act()} FROM {name}_g"
    if active_days:
        spent = f"SELECT coalesce(sum(active_ms), 0)::BIGINT FROM act WHERE {active_days}"
    return f"""{name}_s AS (SELECT * FROM ev WHERE {where}), {name}_g AS (
  SELECT session_id, local_date, coalesce(least(greatest(ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, local_date, event_id), 0), {IDLE}), 0) AS gap
  FROM {name}_s WHERE session_id IS NOT NULL), {name} AS (
  SELECT {counts()}, ({spent}) AS active_ms FROM {name}_s)"""


def change_sql(metric: str) -> str:
    return f"""CASE WHEN p.{metric} = 0 THEN CASE WHEN c.{metric} = 0 THEN 0.0 END
  ELSE floor((c.{metric} - p.{metric})::DOUBLE / p.{metric} * 1000.0 + 0.5) / 10.0 END::DOUBLE AS {metric}_change_pct"""


PERIODS = EV + ACTIVE + "," + ",".join(
    period_sql(name, f"local_date BETWEEN {days}", f"day BETWEEN {days}")
    for name, days in (("c", "DATE '2024-01-20' AND DATE '2024-01-26'"), ("p", "DATE '2024-01-13' AND DATE '2024-01-19'")))


@query("period_over_period", PERIODS + f"""
SELECT c.prompts, p.prompts AS prompts_previous, {change_sql('prompts')}, c.sessions, c.active_ms, p.active_ms AS active_ms_previous,
  {change_sql('active_ms')}, {change_sql('tool_calls')}, round(c.estimated_cost_usd, 6) AS estimated_cost_usd,
  (floor(c.prompts::DOUBLE / c.sessions * 100.0 + 0.5) / 100.0)::DOUBLE AS prompts_per_session,
  floor(c.active_ms::DOUBLE / c.sessions + 0.5)::BIGINT AS ms_per_session FROM c, p""")
def _(spark, sf):
    t, s = v.tables(spark, sf), scope(WEEK)
    return ov.overview(t, s)["period"].select(
        "prompts", "prompts_previous", "prompts_change_pct", "sessions", "active_ms",
        "active_ms_previous", "active_ms_change_pct", "tool_calls_change_pct",
        "estimated_cost_usd", "prompts_per_session", "ms_per_session",
    )


@query("overview_from_rollups", EV + "," + period_sql("c", IN_SPAN) + "," + period_sql("p", IN_PREV) + ACTIVE + f"""
SELECT c.prompts, p.prompts AS prompts_previous, c.sessions, p.sessions AS sessions_previous, c.projects, c.tool_calls,
  (SELECT sum(active_ms)::BIGINT FROM act WHERE {IN_DAYS}) AS active_ms, c.input_tokens, c.estimated_cost_usd FROM c, p""")
def _(spark, sf):
    t, s = v.tables(spark, sf), scope()
    return ov.overview(t, s, *rolled(spark, sf))["period"].select(
        "prompts", "prompts_previous", "sessions", "sessions_previous", "projects", "tool_calls",
        "active_ms", "input_tokens", "estimated_cost_usd",
    )


PAGE = """, b AS (SELECT *, CASE WHEN day >= DATE '2024-01-16' THEN 'current' ELSE 'previous' END AS period FROM roll
  WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'), page AS (
  SELECT CASE WHEN grouping(day) = 0 THEN 'day' WHEN grouping(provider_id) = 0 THEN 'provider_id'
      WHEN grouping(project_id) = 0 THEN 'project_id' WHEN grouping(model) = 0 THEN 'model'
      WHEN grouping(category) = 0 THEN 'category' ELSE 'total' END AS part,
    CASE WHEN grouping(day) = 0 THEN day::VARCHAR WHEN grouping(provider_id) = 0 THEN provider_id
      WHEN grouping(project_id) = 0 THEN project_id WHEN grouping(model) = 0 THEN model
      WHEN grouping(category) = 0 THEN category END AS key,
    period, sum(prompts)::BIGINT AS prompts, sum(responses)::BIGINT AS responses, sum(tool_calls)::BIGINT AS tool_calls,
    sum(prompts + responses + tool_calls + other_events)::BIGINT AS events, sum(input_tokens)::BIGINT AS input_tokens,
    sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read_tokens)::BIGINT AS cache_read_tokens,
    sum(cache_write_tokens)::BIGINT AS cache_write_tokens, round(sum(cost), 6) AS estimated_cost_usd,
    round(sum(confidence_sum), 6) AS confidence_sum, sum(confidences)::BIGINT AS confidences
  FROM b GROUP BY GROUPING SETS ((period), (period, day), (period, provider_id), (period, project_id), (period, model),
    (period, category)))"""


@query("overview_page", NTS + ROLL + PAGE + " SELECT * FROM page")
def _(spark, sf):
    return ov.page_counts(rolled(spark, sf)[0], scope())


@query("overview_page_parts", NTS + ROLL + PAGE + """
SELECT part, coalesce(key, 'Other') AS key, sum(n)::BIGINT AS count FROM (
  SELECT part, key, CASE part WHEN 'model' THEN responses ELSE prompts END AS n FROM page WHERE period = 'current'
    AND (part = 'provider_id' OR part = 'category' OR (part = 'project_id' AND key IS NOT NULL)
      OR (part = 'model' AND key <> '' AND key NOT LIKE '<%'))) WHERE n > 0 GROUP BY 1, 2""")
def _(spark, sf):
    counts = ov.page_counts(rolled(spark, sf)[0], scope())
    parts = [ov.page_part(counts, p).select(F.lit(p).alias("part"), "key", "count")
             for p in ("provider_id", "project_id", "model", "category")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


ASKED = f"(SELECT count(*) FROM ev WHERE event_type = 'prompt' AND {IN_SPAN})"


def of_all(count: str, total: str = ASKED) -> str:
    return f"(floor({count}::DOUBLE / {total} * 1000.0 + 0.5) / 10.0)::DOUBLE AS share"


OVERVIEW_SQL = {
    "sources": DMS + f"""
SELECT ev.provider_id AS key, coalesce(max(p.name), ev.provider_id) AS name, {P} AS count, {of_all('count(*) FILTER (event_type = $$prompt$$)')}
FROM ev LEFT JOIN providers_d p USING (provider_id) WHERE ev.{IN_SPAN} GROUP BY 1 HAVING {P} > 0""",
    "categories": NTS + f"""
SELECT *, {of_all('count')} FROM ({BY_CATEGORY} AND ev.{IN_SPAN} GROUP BY 1)""",
    "projects": DMS + f"""
SELECT ev.project_id AS key, coalesce(max(p.name), ev.project_id) AS name, count(*)::BIGINT AS count, {of_all('count(*)')}
FROM ev LEFT JOIN projects_d p USING (project_id) WHERE event_type = 'prompt' AND ev.project_id IS NOT NULL AND ev.{IN_SPAN}
GROUP BY 1 ORDER BY count DESC, key LIMIT 8""",
    "technologies": NTS + f"""
SELECT technology AS key, count(*)::BIGINT AS count, {of_all('count(*)')} FROM tech_d WHERE {IN_SPAN} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
    "timeline": EV + ACTIVE + f"""
SELECT local_date::VARCHAR AS bucket, {P} AS prompts, {tokens(('input_tokens', 'output_tokens'))}, round(sum(cost), 6) AS estimated_cost_usd,
  count(DISTINCT session_id)::BIGINT AS sessions,
  (SELECT coalesce(sum(active_ms), 0)::BIGINT FROM act WHERE day = ev.local_date) AS active_ms
FROM ev WHERE {IN_SPAN} GROUP BY local_date""",
}

for _part in ("sources", "categories", "projects", "technologies", "models", "timeline"):

    @query(f"overview_{_part}", OVERVIEW_SQL.get(_part, "").replace("$$", "'") or None)
    def _(spark, sf, part=_part):
        t, s = v.tables(spark, sf), scope()
        return ov.overview(t, s, *rolled(spark, sf))[part]


for _part in ("period", "sources", "categories", "projects", "technologies", "models", "timeline"):

    @query(f"overview_routes_{_part}", "SELECT 0::BIGINT AS different")
    def _(spark, sf, part=_part):
        """Rows of nine days that only one of the two routes, log and rollups, gives."""
        t, roll = v.tables(spark, sf), rolled(spark, sf)
        nine = scope(DaySpan(dt.date(2024, 1, 18), dt.date(2024, 1, 26)))
        direct = flat(ov.overview(t, replace(nine, use_rollups=False))[part])
        routed = flat(ov.overview(t, replace(nine, use_rollups=True), *roll)[part].select(*direct.columns))
        return direct.exceptAll(routed).unionByName(routed.exceptAll(direct)).agg(
            F.count(F.lit(1)).alias("different"))


@query("insights")
def _(spark, sf):
    return insights.findings(v.tables(spark, sf), scope(WEEK))


@query("insight_trend", EV + f""", n AS (SELECT
  count(*) FILTER ({IN_SPAN})::DOUBLE AS c, count(*) FILTER ({IN_PREV})::DOUBLE AS p FROM ev WHERE event_type = 'prompt'), x AS (
  SELECT c, p, floor((c - p) / p * 1000.0 + 0.5) / 10.0 AS change FROM n)
SELECT 'usage_trend' AS id, round((90.0 + least(abs(change), 50.0))::DOUBLE, 6) AS score, floor(abs(change) + 0.5)::BIGINT AS value,
  c::BIGINT AS sample_size FROM x WHERE abs(change) >= 15 AND c >= 40""")
def _(spark, sf):
    found = insights.findings(v.tables(spark, sf), scope())
    return found.where(F.col("id") == "usage_trend").select("id", "score", "value", "sample_size")


@query("suppressed_insights")
def _(spark, sf):
    return insights.suppressed(v.tables(spark, sf), scope(WEEK))


@query("summary_sentence")
def _(spark, sf):
    return insights.summary(v.tables(spark, sf), scope())


@query("activity_page", EVERY + """
SELECT ev.event_id, ev.ts_ms, event_type, coalesce(p.name, ev.provider_id) AS provider_name, pj.name AS project_name,
  category, round(confidence, 6) AS category_confidence, preview, tool_name, is_subagent::BIGINT AS is_subagent
FROM ev LEFT JOIN providers_d p USING (provider_id) LEFT JOIN projects_d pj USING (project_id)
LEFT JOIN note USING (event_id) LEFT JOIN prompts_d pd USING (event_id)
WHERE (ev.ts_ms, ev.event_id) < (1705500000000, 'k') ORDER BY ev.ts_ms DESC, ev.event_id DESC LIMIT 201""")
def _(spark, sf):
    return feed.activity(v.tables(spark, sf), limit=200, cursor=(1_705_500_000_000, "k")).select(
        "event_id", "ts_ms", "event_type", "provider_name", "project_name", "category",
        "category_confidence", "preview", "tool_name", "is_subagent",
    )


@query("activity_cursor", EV + """
SELECT ts_ms, event_id FROM (SELECT *, row_number() OVER (ORDER BY ts_ms DESC, event_id DESC) AS n FROM ev) WHERE n = 50""")
def _(spark, sf):
    return feed.next_cursor(feed.activity(v.tables(spark, sf), limit=50), 50)


@query("folded_feed", EV + """, p AS (SELECT *, row_number() OVER w AS place, event_type IN ('prompt', 'error') AS alone FROM ev
  WINDOW w AS (ORDER BY ts_ms DESC, event_id DESC) ORDER BY place LIMIT 201), m AS (
  SELECT *, (lag(local_date) OVER w IS DISTINCT FROM local_date) AS new_day, coalesce(lag(alone) OVER w, true) AS after_alone
  FROM p WINDOW w AS (ORDER BY place)), r AS (
  SELECT *, sum((alone OR new_day OR after_alone)::INT) OVER (ORDER BY place) AS run FROM m)
SELECT CASE WHEN count(*) > 1 THEN 'run' ELSE 'item' END AS kind, min(place)::BIGINT AS place, count(*)::BIGINT AS events,
  count(*) FILTER (event_type = 'response')::BIGINT AS replies, count(*) FILTER (event_type = 'tool_call')::BIGINT AS tool_calls FROM r GROUP BY run
UNION ALL SELECT 'day', place, (SELECT count(*) FROM p WHERE p.local_date = m.local_date), NULL, NULL FROM m WHERE new_day""")
def _(spark, sf):
    page = feed.activity(v.tables(spark, sf), limit=200)
    return feed.fold_feed(page).select("kind", "place", "events", "replies", "tool_calls")


# ---- maintenance and export -------------------------------------------------------------------

UTC = dt.timezone.utc
RANGE = mt.DeleteScope("range", from_ts=dt.datetime(2024, 1, 15, tzinfo=UTC),
                       to_ts=dt.datetime(2024, 1, 22, tzinfo=UTC))
IN_RANGE = "ts_ms BETWEEN 1705276800000 AND 1705881600000"

for _label, _scope, _where in (
    ("provider", mt.DeleteScope("provider", provider_id="beta_ide"), "provider_id = 'beta_ide'"),
    ("range", RANGE, IN_RANGE), ("all", mt.DeleteScope("all"), "true"),
):

    @query(f"delete_preview_{_label}", PRS + f"""
SELECT count(*)::BIGINT AS events, count(p.event_id)::BIGINT AS prompts, count(DISTINCT session_id)::BIGINT AS sessions,
  count(DISTINCT project_id)::BIGINT AS projects FROM (SELECT * FROM ev WHERE {_where}) e LEFT JOIN (SELECT event_id FROM prompts_d) p USING (event_id)""")
    def _(spark, sf, scope=_scope):
        return mt.delete_preview(v.tables(spark, sf), scope)


@query("after_delete", EVERY + f"""
SELECT 'events' AS "table", count(*)::BIGINT AS rows FROM ev WHERE NOT {IN_RANGE}
UNION ALL SELECT 'prompts', count(*) FROM prompts_d JOIN ev USING (event_id) WHERE NOT ev.{IN_RANGE}
UNION ALL SELECT 'tool_calls', count(*) FROM ev WHERE event_type = 'tool_call' AND NOT {IN_RANGE}
UNION ALL SELECT 'technologies', count(*) FROM tech_d JOIN ev USING (event_id) WHERE NOT {IN_RANGE}
UNION ALL SELECT 'projects', count(DISTINCT project_id) FROM ev WHERE NOT {IN_RANGE}""")
def _(spark, sf):
    left = mt.delete(v.tables(spark, sf), RANGE)
    return mt.table_counts({
        n: getattr(left, n) for n in ("events", "prompts", "tool_calls", "technologies", "projects")
    })


@query("after_erasing_text", PRS + """
SELECT count(*)::BIGINT AS prompts, 0::BIGINT AS texts, 0::BIGINT AS previews, sum(char_length)::BIGINT AS chars, 0::BIGINT AS responses FROM prompts_d""")
def _(spark, sf):
    left = mt.delete(v.tables(spark, sf), mt.DeleteScope("prompts"))
    return left.prompts.agg(
        F.count(F.lit(1)).alias("prompts"), F.count("text").alias("texts"),
        F.count("preview").alias("previews"), F.sum("char_length").alias("chars"),
    ).withColumn("responses", left.responses.agg(F.count(F.lit(1))).scalar())


KEPT_FROM = dt.datetime(2024, 2, 20, 6, tzinfo=UTC)


@query("after_retention", PRS + """
SELECT event_id, (ts_ms < 1705730400000)::BIGINT AS cleared FROM prompts_d""")
def _(spark, sf):
    left = mt.apply_retention(v.tables(spark, sf), 1, KEPT_FROM)
    return left.prompts.select("event_id", F.col("text").isNull().alias("cleared"))


@query("retention_count", PRS + """
SELECT count(*)::BIGINT AS cleared FROM prompts_d WHERE ts_ms < 1705730400000""")
def _(spark, sf):
    return mt.expired_count(v.tables(spark, sf), 1, KEPT_FROM)


@query("table_counts", EVERY + """
SELECT 'events' AS "table", count(*)::BIGINT AS rows FROM ev UNION ALL SELECT 'prompts', count(*) FROM prompts_d
UNION ALL SELECT 'contexts', count(*) FROM ctx_d UNION ALL SELECT 'projects', count(*) FROM projects_d""")
def _(spark, sf):
    t = v.tables(spark, sf)
    return mt.table_counts({n: getattr(t, n) for n in ("events", "prompts", "contexts", "projects")})


@query("export_rows", EVERY + """, x AS (SELECT event_id, string_agg(technology, ',' ORDER BY technology) AS technologies FROM tech_d GROUP BY 1)
SELECT ev.event_id AS id, strftime(make_timestamp(ev.ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS "timestamp",
  is_subagent::BIGINT AS "isSubagent", pj.name AS "projectName", category, technologies, tool_name AS "toolName",
  char_length::BIGINT AS "charLength", sha256(text) AS text_hash
FROM ev LEFT JOIN projects_d pj USING (project_id) LEFT JOIN note USING (event_id) LEFT JOIN prompts_d USING (event_id) LEFT JOIN x USING (event_id)""")
def _(spark, sf):
    rows = ex.csv_rows(ex.export_rows(v.tables(spark, sf)))
    return rows.select("id", "timestamp", "isSubagent", "projectName", "category", "technologies",
                       "toolName", "charLength", F.sha2("promptText", 256).alias("text_hash"))


@query("export_without_text", EV + """
SELECT count(*)::BIGINT AS rows, 0::BIGINT AS texts FROM ev""")
def _(spark, sf):
    rows = ex.export_rows(v.tables(spark, sf), None, include_prompts=False)
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count("promptText").alias("texts"))


@query("export_manifest")
def _(spark, sf):
    return ex.manifest(v.tables(spark, sf), F_SPAN, True, "2024-02-01T00:00:00.000Z")


@query("reimported_export", EV + f"""
SELECT {P} AS prompts, count(*)::BIGINT AS events, count(DISTINCT session_id)::BIGINT AS sessions, count(DISTINCT project_id)::BIGINT AS projects,
  {tokens()} FROM ev""")
def _(spark, sf):
    from usagelake.operators import normalize as nz

    t, saved = v.tables(spark, sf), v.store(spark, sf)
    path = saved.path("export")
    rows = ex.export_rows(t)
    # Lines of text and names that repeat are several times the store's columns.
    ex.write_json(rows, ex.manifest(t, None, True, "2024-02-01T00:00:00.000Z"), path, "gzip")
    ex.write_csv(rows, saved.path("export_csv"), "gzip")
    events = nz.normalize(ex.read_export(spark, path), v.SETTINGS)
    return tt.counters(events).select(
        "prompts", "events", "sessions", "projects", *tt.TOKENS
    )


@query("ingest_audit")
def _(spark, sf):
    t = v.tables(spark, sf)
    batches = t.events.groupBy("provider_id", "local_date").agg(
        F.count(F.lit(1)).alias("accepted"), F.max("ts_ms").alias("started_at"),
        F.max("event_id").alias("batch_id"),
    )
    return push.recent_batches(batches, 10)
