"""Deterministic keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model families, first match wins.
FAMILY_PATTERNS = (
    ("opus", "fable|mythos"),
    ("opus", "opus"),
    ("sonnet", "sonnet"),
    ("haiku", "haiku"),
    ("gpt", "^gpt|openai|o[134]-"),
    ("gemini", "gemini"),
    ("llama", "llama"),
)


def model_family(model: Column) -> Column:
    out = F.lit("unknown")
    for family, pattern in reversed(FAMILY_PATTERNS):
        out = F.when(model.rlike("(?i)" + pattern), family).otherwise(out)
    return F.when(F.coalesce(model, F.lit("")) != "", out)


def is_real_model(model: Column) -> Column:
    """A model somebody chose: present and not a placeholder in angle brackets."""
    return model.isNotNull() & (model != "") & ~model.startswith("<")


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def content_identity(row: dict[str, Column]) -> Column:
    """Stands in for an external id: two events in one millisecond stay two."""
    texts = ("session_id", "parent_event_id", "model", "working_directory", "tool_name",
             "prompt", "response")
    counts = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")
    head = F.regexp_replace(F.to_json(F.array(*[_blank(row[c]) for c in texts])), r"\]\z", "")
    tail = [F.coalesce(row[c].cast("string"), F.lit("null")) for c in counts]
    return F.sha2(F.concat(F.concat_ws(",", head, *tail), F.lit("]")), 256)


def dedupe_key(
    provider: Column, external_id: Column, event_type: Column, iso_ts: Column,
    discriminator: Column, content_hash: Column,
) -> Column:
    """An external id is the identity; without one, content and clock are."""
    known = F.concat_ws("|", provider, external_id, event_type, _blank(discriminator))
    unknown = F.concat_ws(
        "|", provider, F.concat(F.lit("#"), content_hash), event_type, iso_ts,
        _blank(discriminator),
    )
    return F.sha2(F.when(_blank(external_id) != "", known).otherwise(unknown), 256)


def event_id(key: Column) -> Column:
    return F.substring(key, 1, 26)


def session_key(provider: Column, external_session: Column) -> Column:
    """Two tools reusing one session id must not collide."""
    return F.when(
        _blank(external_session) != "",
        F.substring(F.sha2(F.concat_ws("|", provider, external_session), 256), 1, 24),
    )


def project_key(path: Column) -> Column:
    return F.when(_blank(path) != "", F.substring(F.sha2(path, 256), 1, 24))


def project_name(path: Column) -> Column:
    """Last path segment in either separator style, without a drive colon."""
    parts = F.filter(F.split(path, r"[\\/]+"), lambda p: ~p.isin("", ".", ".."))
    last = F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r":\z", "")
    return F.coalesce(F.nullif(last, F.lit("")), path)


def repository_name(remote: Column) -> Column:
    cleaned = F.regexp_replace(remote, r"\.git\z", "")
    return F.nullif(F.regexp_extract(cleaned, r"[:/]([^/:]+/[^/:]+)\z", 1), F.lit(""))


def display_name(provider: Column) -> Column:
    """Words of the id with the first letter raised and the rest left alone."""
    words = F.filter(F.split(provider, r"[-_.\s]+"), lambda w: w != "")
    titled = F.transform(
        words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))
    )
    return F.when(F.size(words) > 0, F.array_join(titled, " ")).otherwise(provider)
