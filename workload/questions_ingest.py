"""Questions about logs that went through ingest: followed files, late answers, what waits, the audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from usagelake.operators import prompts as pr
from workload import followed
from workload.questions_log import TRANSCRIPT
from workload.questions_usage import FOLDS
from workload.registry import query

#: Turns of one conversation are 40 s apart, so a later turn's reply comes later.
ANSWERED = """EXISTS (SELECT 1 FROM c AS r WHERE r.conv_id = c.conv_id AND r.role = 'assistant' AND r.turn >= c.turn)"""


@query("followed_events", TRANSCRIPT + f"""
SELECT name || '-u' AS external_id, 'prompt' AS event_type,
  CASE WHEN {ANSWERED} THEN 'claude-opus-4-8' END AS model, NULL::VARCHAR AS tool_name, NULL::BIGINT AS succeeded,
  NULL::BIGINT AS input_tokens FROM c WHERE role = 'user'
UNION ALL SELECT 'msg-' || name, 'response', 'claude-opus-4-8', NULL, NULL, length(text) FROM c WHERE role = 'assistant'
UNION ALL SELECT 'tool-' || name, 'tool_call', 'claude-opus-4-8',
  CASE WHEN turn % 3 = 0 THEN 'Edit' ELSE 'Read' END, (turn % 4 <> 1)::BIGINT, NULL FROM c WHERE role = 'assistant'
UNION ALL SELECT name || '-s', 'compaction', NULL, NULL, NULL, NULL FROM c WHERE role = 'system'""")
def _(spark, sf):
    saved = followed.ingest(spark, sf).store
    calls = saved.read("tool_calls").select("event_id", "tool_name", F.col("succeeded").cast("bigint").alias("succeeded"))
    return saved.read("events").join(calls, "event_id", "left").select(
        "external_id", "event_type", "model", "tool_name", "succeeded", "input_tokens")


@query("followed_days", TRANSCRIPT + """
SELECT event_type, count(*) AS events, count(DISTINCT conv_id)::BIGINT AS sessions FROM (
  SELECT conv_id, CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'response' ELSE 'compaction' END AS event_type FROM c
  UNION ALL SELECT conv_id, 'tool_call' FROM c WHERE role = 'assistant') GROUP BY 1""")
def _(spark, sf):
    out = followed.ingest(spark, sf)
    out.compact()
    return out.store.stored("events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"))


@query("followed_waiting", TRANSCRIPT + f"""
SELECT 'waiting' AS what, count(*) AS n FROM c WHERE role = 'user' AND NOT {ANSWERED}
UNION ALL SELECT 'calls', 0 UNION ALL SELECT 'outcomes', 0""")
def _(spark, sf):
    log = followed.ingest(spark, sf).store.log
    counts = None
    for name in ("waiting", "calls", "outcomes"):
        rows = log.waiting(name)
        n = F.count(F.lit(1)) if rows is not None else F.lit(0).cast("bigint")
        one = (spark.range(1) if rows is None else rows).agg(n.alias("n")).select(F.lit(name).alias("what"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@query("followed_search", TRANSCRIPT + f"""
SELECT name || '-u' AS external_id FROM c WHERE role = 'user' AND contains({FOLDS}, ' th') AND contains({FOLDS}, ' re')""")
def _(spark, sf):
    """From the postings that ingest and compaction kept; the texts are not read."""
    saved = followed.ingest(spark, sf).store
    found = pr.search_index(saved.read("terms"), "TH ré")
    return saved.read("events").join(found, "event_id", "left_semi").select("external_id")


@query("followed_audit", TRANSCRIPT + """, n AS (
  SELECT count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a,
    count(*) FILTER (role = 'system') AS s FROM c)
SELECT 'push-0' AS batch_id, u + 2 * a AS accepted, 2 * a AS deduped, 0::BIGINT AS failed, 0::BIGINT AS skipped FROM n
UNION ALL SELECT 'push-1', s, 0, 0, 0 FROM n
UNION ALL SELECT 'push-2', 0, 0, 0, 0""")
def _(spark, sf):
    return followed.ingest(spark, sf).audit().select("batch_id", "accepted", "deduped", "failed", "skipped")
