"""Shared table expressions of the reference SQL: the log, its prompts and their labels."""

from __future__ import annotations

from usagelake.functions.ids import FAMILY_PATTERNS
from usagelake.functions.pricing import PRICE_CARD
from usagelake.rules import intent, technology
from usagelake.rules.secrets import PLACEHOLDER, SECRET_RULES
from workload import views as v


def q(text) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(q(x) for x in values) + "]"


WS = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
D0 = v.DAY0_MS

RAW = f"""
raw AS (
  SELECT CASE WHEN event_id % 13 <> 0 THEN 'ev-' || event_id END AS external_id,
    {items(v.PROVIDERS)}[user_id % 4 + 1] AS provider_id,
    CASE WHEN event_type = 'view' THEN {items(v.MODELS)}[event_id % 6 + 1]
         WHEN event_type = 'purchase' AND event_id % 2 = 1 THEN 'claude-opus-4-8' END AS model,
    epoch_us(ts) // 1000 AS ts_ms,
    CASE WHEN event_id % 17 <> 0 THEN [-480, 0, 330][user_id % 3 + 1] END AS tz,
    CASE WHEN event_id % 19 <> 0 THEN 's' || (user_id % 20) END AS session,
    event_id % 7 = 0 AS is_subagent,
    CASE WHEN event_id % 23 <> 0 THEN
      CASE WHEN k % 10 = 9 THEN 'C:\\work\\p9'
           ELSE '/home/dev/p' || (k % 10) || CASE WHEN k % 3 = 0 THEN '/src'
                WHEN k % 3 = 1 THEN '/src/api' ELSE '' END END END AS cwd,
    CASE event_type WHEN 'click' THEN 'prompt' WHEN 'view' THEN 'response'
         WHEN 'purchase' THEN 'tool_call' WHEN 'signup' THEN 'session_start'
         ELSE 'error' END AS event_type,
    CASE WHEN event_type = 'click' THEN {items(v.LEADS)}[event_id % {len(v.LEADS)} + 1] END AS prompt,
    CASE WHEN event_type = 'view' AND event_id % 4 = 0 THEN 'ok ' || k END AS response,
    CASE WHEN event_type = 'purchase' THEN {items(v.TOOLS)}[event_id % 10 + 1] END AS tool_name,
    CASE WHEN event_type = 'purchase' AND event_id % 3 < 2 THEN event_id % 3 = 0 END AS tool_ok,
    CASE WHEN event_type = 'view' AND event_id % 11 <> 0 THEN floor(value * 10)::BIGINT END AS input_tokens,
    CASE WHEN event_type = 'view' AND event_id % 11 <> 0 THEN floor(value * 3)::BIGINT END AS output_tokens,
    CASE WHEN event_type = 'view' AND event_id % 5 <> 0 THEN floor(value * 100)::BIGINT END AS cache_read_tokens,
    CASE WHEN event_type = 'view' AND event_id % 3 <> 0 THEN floor(value * 20)::BIGINT END AS cache_write_tokens,
    CASE WHEN event_type = 'view' AND event_id % 6 <> 0 THEN floor(value * 30 * (event_id % 2))::BIGINT END AS cache_write_1h,
    floor(value * 100)::BIGINT AS duration_ms,
    CASE WHEN event_type = 'purchase' THEN lower({items(v.EXTENSIONS)}[event_id % 5 + 1]) END AS ext
  FROM (SELECT *, regexp_extract(props, '(\\d+)', 1)::INT AS k FROM events)
  UNION ALL
  SELECT 'cv-' || conv_id || '-' || turn, 'chat-log',
    CASE WHEN role = 'assistant' THEN
      ['claude-sonnet-4-5', 'gemini-2.5-pro', 'claude-opus-4-1'][conv_id % 3 + 1] END,
    {D0 + 9 * 86_400_000} + conv_id * 2220000 + turn * 70000, 0, 'c' || conv_id, false, NULL,
    CASE role WHEN 'user' THEN 'prompt' WHEN 'assistant' THEN 'response' ELSE 'notification' END,
    CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'assistant' THEN text END, NULL, NULL,
    CASE WHEN role = 'assistant' THEN length(text) END,
    CASE WHEN role = 'assistant' THEN length(text) * 2 END, NULL, NULL, NULL, NULL, NULL
  FROM conversations
  UNION ALL
  SELECT 'doc-' || doc_id, 'doc-review', NULL, {D0 + 4 * 86_400_000} + doc_id * 97000, 60,
    'd-' || source, false, '/srv/' || source || '/' || lang, 'prompt',
    CASE WHEN doc_id % 3 = 0 THEN {items(v.LEADS)}[doc_id % {len(v.LEADS)} + 1] || chr(10) || text
         ELSE text END,
    NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
  FROM documents
)"""


def _price(column: int) -> str:
    rows = sorted(PRICE_CARD, key=lambda r: -len(r[0]))
    return "CASE " + " ".join(
        f"WHEN lower(model) LIKE {q(r[0] + '%')} THEN {r[column]!r}::DOUBLE" for r in rows
    ) + " END"


def _family() -> str:
    return "CASE WHEN coalesce(model, '') = '' THEN NULL " + " ".join(
        f"WHEN regexp_matches(model, {q('(?i)' + p)}) THEN {q(f)}" for f, p in FAMILY_PATTERNS
    ) + " ELSE 'unknown' END"


def _n(column: str) -> str:
    return f"coalesce({column}, 0)::DOUBLE"


COST = f"""(({_n('input_tokens')} * rin + {_n('output_tokens')} * rout
  + {_n('cache_read_tokens')} * (rin * 0.1::DOUBLE)
  + greatest({_n('cache_write_tokens')} - least({_n('cache_write_1h')}, {_n('cache_write_tokens')}), 0) * (rin * 1.25::DOUBLE)
  + least({_n('cache_write_1h')}, {_n('cache_write_tokens')}) * (rin * 2.0::DOUBLE)) / 1000000.0::DOUBLE)"""

NY = """((epoch_ms(timezone('America/New_York', timezone('UTC', make_timestamp(ts_ms * 1000)))) - ts_ms) // 60000)"""

EV = f"""
ev0 AS (
  SELECT *, coalesce(tz, {NY})::BIGINT AS off,
    strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS iso,
    {_price(1)} AS rin, {_price(2)} AS rout, {_family()} AS model_family,
    sha256(rtrim(to_json([coalesce(session, ''), '', coalesce(model, ''), coalesce(cwd, ''),
      coalesce(tool_name, ''), coalesce(prompt, ''), coalesce(response, '')])::VARCHAR, ']')
      || ',' || coalesce(input_tokens::VARCHAR, 'null') || ',' || coalesce(output_tokens::VARCHAR, 'null')
      || ',' || coalesce(cache_read_tokens::VARCHAR, 'null') || ',' || coalesce(cache_write_tokens::VARCHAR, 'null')
      || ']') AS content_hash
  FROM raw
), ev1 AS (
  SELECT *, ts_ms + off * 60000 AS lms,
    sha256(CASE WHEN external_id IS NOT NULL
      THEN provider_id || '|' || external_id || '|' || event_type || '|' || coalesce(tool_name, '')
      ELSE provider_id || '|#' || content_hash || '|' || event_type || '|' || iso || '|' || coalesce(tool_name, '')
      END) AS dedupe_key
  FROM ev0
), ev AS (
  SELECT substr(dedupe_key, 1, 26) AS event_id, dedupe_key, provider_id, model, model_family, ts_ms,
    off AS tz_offset_minutes, DATE '1970-01-01' + (lms // 86400000)::INT AS local_date,
    ((lms % 86400000) // 3600000)::BIGINT AS local_hour,
    ((lms // 86400000 + 4) % 7)::BIGINT AS local_weekday,
    CASE WHEN session IS NOT NULL THEN substr(sha256(provider_id || '|' || session), 1, 24) END AS session_id,
    session AS external_session_id, external_id, is_subagent, cwd AS working_directory,
    CASE WHEN cwd IS NOT NULL THEN substr(sha256(cwd), 1, 24) END AS project_id, event_type,
    input_tokens, output_tokens, cache_read_tokens, cache_write_tokens,
    CASE WHEN {COST} > 0 THEN floor({COST} * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE END AS cost,
    duration_ms, prompt, response, tool_name, tool_ok, nullif(ext, '') AS ext
  FROM ev1
)"""

DIMS = """
projects_d AS (
  SELECT project_id, working_directory AS path,
    coalesce(nullif(regexp_replace(list_filter(regexp_split_to_array(working_directory, '[\\\\/]+'),
      lambda x: x NOT IN ('', '.', '..'))[-1], ':$', ''), ''), working_directory) AS name,
    min(ts_ms) AS first_ms, max(ts_ms) AS last_ms
  FROM ev WHERE project_id IS NOT NULL GROUP BY 1, 2
), providers_d AS (
  SELECT provider_id, list_aggregate(list_transform(list_filter(regexp_split_to_array(provider_id, '[-_.\\s]+'),
      lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', ' ') AS name,
    provider_id <> 'delta tool' AS enabled
  FROM (SELECT DISTINCT provider_id FROM ev) WHERE provider_id <> 'gamma.chat'
)"""


def normalized(column: str) -> str:
    out = f"lower({column})"
    for pattern in (
        r"```[\s\S]*?```", r"`[^`]*`", rf"\bhttps?://[^{WS}]+",
        r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
        r"(?:[A-Za-z]:)?[\\/](?:[\w.@-]+[\\/])+[\w.@-]+", r"\b\d[\d.,_-]*\b",
    ):
        out = f"regexp_replace({out}, {q(pattern)}, ' ', 'g')"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def strip(column: str) -> str:
    return f"regexp_replace({column}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def utf16(column: str) -> str:
    return (
        f"(length({column}) + length(regexp_replace({column}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
    )


def preview(column: str) -> str:
    flat = f"trim(regexp_replace({column}, '[{WS}]+', ' ', 'g'))"
    return f"CASE WHEN length({flat}) <= 220 THEN {flat} ELSE substr({flat}, 1, 219) || '…' END"


def _redaction() -> str:
    """One table expression per rule: bracket, spare placeholders, count, replace."""
    parts = ["red0 AS (SELECT event_id, local_date, ts_ms, prompt AS original, prompt AS t, 0 AS n,"
             " ''::VARCHAR AS kinds FROM ev WHERE event_type = 'prompt' AND prompt IS NOT NULL)"]
    for i, rule in enumerate(SECRET_RULES, 1):
        flags = "(?i)" if rule.ignore_case else ""
        pattern = f"{flags}({rule.before})({rule.secret})({rule.after})"
        marked = f"regexp_replace(t, {q(pattern)}, '\\1﷐\\2﷑\\3', 'g')"
        if rule.before:
            spared = rf"(?i)﷐((?:{PLACEHOLDER})|\[redacted:[^﷑]*)﷑"
            marked = f"regexp_replace({marked}, {q(spared)}, '\\1', 'g')"
        parts.append(
            f"red{i} AS (SELECT event_id, local_date, ts_ms, original,"
            f" regexp_replace(m, '﷐[^﷑]*﷑', '[redacted:{rule.kind}]', 'g') AS t,"
            f" n + length(m) - length(replace(m, '﷐', '')) AS n,"
            f" CASE WHEN contains(m, '﷐') THEN kinds || '|{rule.kind}' ELSE kinds END AS kinds"
            f" FROM (SELECT *, {marked} AS m FROM red{i - 1}))"
        )
    return ",\n".join(parts)


PR = f"""
{_redaction()},
pr AS MATERIALIZED (
  SELECT event_id, local_date, ts_ms, original, t AS text, n AS redaction_count,
    substr(kinds, 2) AS kinds, {normalized('original')} AS norm, {normalized('t')} AS stored_norm,
    sha256(original) AS text_hash, {utf16('original')} AS char_length,
    length(regexp_extract_all(original, '[^{WS}]+')) AS word_length,
    CASE WHEN t <> '' THEN {preview('t')} END AS preview
  FROM red{len(SECRET_RULES)}
), prompts_d AS (
  SELECT *, sha256(CASE WHEN norm <> '' THEN norm ELSE 'exact:' || {strip('original')} END)
    AS normalized_hash FROM pr
)"""


def _contains(padded: str, terms) -> list[str]:
    return [f"contains({padded}, {q(' ' + t + ' ')})" for t in terms]


def _scores() -> str:
    rows = []
    order = [c for c, _, _ in intent.LEXICONS]
    for place, (category, weight, terms) in enumerate(intent.LEXICONS):
        lex = f"{weight} * (" + " + ".join(f"{t}::INT" for t in _contains("pad", terms)) + ")"
        verb = "CASE verb " + " ".join(
            f"WHEN {i} THEN {w}" for i, (c, w, _) in enumerate(intent.VERB_HEADS) if c == category
        ) + " ELSE 0 END" if any(c == category for c, _, _ in intent.VERB_HEADS) else "0"
        tools, first = [], "NULL"
        for i, (c, w, any_of, none_of) in reversed(list(enumerate(intent.TOOL_SIGNALS))):
            if c != category:
                continue
            test = f"list_has_any(tools, {items(any_of)})"
            if none_of:
                test += f" AND NOT list_has_any(tools, {items(none_of)})"
            tools.append(f"CASE WHEN {test} THEN {w} ELSE 0 END")
            first = f"CASE WHEN {test} THEN {len(order) + 1 + i} ELSE {first} END"
        tool = " + ".join(tools) or "0"
        rows.append(
            f"{{'neg': -(({lex}) + ({verb}) + ({tool})),"
            f" 'rank': CASE WHEN ({lex}) > 0 THEN {place} WHEN ({verb}) > 0 THEN {len(order)}"
            f" ELSE {first} END, 'category': {q(category)}}}"
        )
    return "[" + ",\n".join(rows) + "]"


def _verb() -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches(n, {q(p)}) THEN {i}" for i, (_, _, p) in enumerate(intent.VERB_HEADS)
    ) + " ELSE -1 END"


def _technologies() -> str:
    rows = []
    for t in technology.TECHNOLOGIES:
        alias = " OR ".join(_contains("pad", t.aliases))
        ext = f" WHEN list_has_any(exts, {items(t.extensions)}) THEN 0.7" if t.extensions else ""
        rows.append(f"{{'neg': CASE WHEN {alias} THEN 0.85{ext} END, 'name': {q(t.name)}}}")
    found = "[" + ",\n".join(rows) + "]"
    return (
        f"list_sort(list_transform(list_filter({found}, lambda x: x.neg IS NOT NULL),"
        f" lambda x: {{'neg': -(x.neg::DOUBLE), 'name': x.name}}))"
    )


def _contexts() -> str:
    rows = []
    for place, (context, terms) in enumerate(technology.CONTEXT_TERMS):
        names = [t.name for t in technology.TECHNOLOGIES if context in t.contexts]
        from_terms = "(" + " + ".join(f"{t}::INT" for t in _contains("pad", terms)) + ")"
        from_tech = (
            f"coalesce(list_sum(list_transform(list_filter(techs, lambda x: x.name IN"
            f" ({', '.join(q(n) for n in names)})), lambda x: -x.neg)), 0.0)"
        )
        cases = []
        for spot in (0, 1):
            at = [t.name for t in technology.TECHNOLOGIES
                  if len(t.contexts) > spot and t.contexts[spot] == context]
            if at:
                cases.append(f"WHEN x.name IN ({', '.join(q(n) for n in at)}) THEN i * 2 + {spot}")
        implied = (
            f"100 + list_min(list_transform(techs, lambda x, i: CASE {' '.join(cases)} END))"
            if cases else "NULL"
        )
        rows.append(
            f"{{'score': ({from_terms} + {from_tech})::DOUBLE, 'rank': CASE WHEN {from_terms} > 0"
            f" THEN {place} ELSE {implied} END, 'name': {q(context)}}}"
        )
    return "list_filter([" + ",\n".join(rows) + "], lambda x: x.score > 0)"


NOTE = f"""
tools_d AS (
  SELECT p.event_id, list_sort(list(DISTINCT t.tool_name)) AS tools
  FROM ev p JOIN ev t ON t.session_id = p.session_id AND t.event_type = 'tool_call'
    AND t.ts_ms > p.ts_ms AND t.ts_ms <= p.ts_ms + 300000
  WHERE p.event_type = 'prompt' GROUP BY 1
), n0 AS MATERIALIZED (
  SELECT p.event_id, p.local_date, stored_norm AS n, ' ' || stored_norm || ' ' AS pad,
    coalesce(tools, []::VARCHAR[]) AS tools,
    list_distinct(list_transform(regexp_extract_all(text, '[\\w./\\\\@-]*\\.([A-Za-z0-9]{{1,8}})\\b', 1),
      lambda x: lower(x))) AS exts
  FROM prompts_d p LEFT JOIN tools_d USING (event_id)
), n1 AS (SELECT *, {_verb()} AS verb FROM n0
), n2 AS (
  SELECT *, list_sort(list_filter({_scores()}, lambda x: x.neg < 0)) AS s,
    {_technologies()} AS techs
  FROM n1
), n3 AS (
  SELECT *, -s[1].neg AS best, -s[2].neg AS second,
    list_sum(list_transform(s, lambda x: -x.neg)) AS total, {_contexts()} AS areas
  FROM n2
), n4 AS (
  SELECT *, CASE WHEN len(s) = 0 THEN 0.0 ELSE floor(least(1.0::DOUBLE, (best::DOUBLE / total) * 0.5::DOUBLE
      + coalesce((best - second)::DOUBLE / best, 1.0::DOUBLE) * 0.25::DOUBLE
      + least(1.0::DOUBLE, best / 10.0::DOUBLE) * 0.25::DOUBLE) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS confidence,
    list_sum(list_transform(areas, lambda x: x.score)) AS area_total
  FROM n3
), note AS MATERIALIZED (
  SELECT event_id, local_date, tools, s, confidence::DOUBLE AS confidence,
    CASE WHEN len(s) = 0 OR confidence < 0.3 THEN 'Other' ELSE s[1].category END AS category,
    techs,
    coalesce(list_sort(list_filter(list_transform(areas, lambda x:
      {{'neg': -(floor(x.score / area_total * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE), 'rank': x.rank, 'name': x.name}}),
      lambda x: -x.neg >= 0.15)), []) AS ctx
  FROM n4
), tech_d AS (
  SELECT event_id, local_date, t.name AS technology, -t.neg AS confidence
  FROM (SELECT event_id, local_date, unnest(techs) AS t FROM note)
), ctx_d AS (
  SELECT event_id, local_date, c.name AS context, -c.neg AS confidence
  FROM (SELECT event_id, local_date, unnest(ctx) AS c FROM note)
)"""

IDLE = v.IDLE_MS
TAIL = 60_000


def gaps(source: str = "ev", idle: int = IDLE, keys: str = "session_id") -> str:
    """Clamped gaps per event of a slice, as table expression ``g``."""
    return f"""
g AS (
  SELECT *, coalesce(least(greatest(ts_ms - lag(ts_ms) OVER (
      PARTITION BY {keys} ORDER BY ts_ms, local_date, event_id), 0), {idle}), 0) AS gap
  FROM {source} WHERE session_id IS NOT NULL
)"""


def active(tail: int = TAIL) -> str:
    return f"(coalesce(sum(gap), 0) + count(DISTINCT session_id || '|' || local_date) * {tail})::BIGINT"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


LOG = (RAW, EV)
DIM = (*LOG, DIMS)
TEXT = (*LOG, PR)
NOTES = (*LOG, PR, NOTE)
ALL = (*LOG, DIMS, PR, NOTE)
