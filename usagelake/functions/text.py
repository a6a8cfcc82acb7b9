"""Prompt text measures: fingerprint, word count, preview, tokens, extensions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.exprs import EDGE, NON_SPACE, SPACE, let, strip

# What a fingerprint ignores, in the order it is removed. Each comes with the
# characters without which it cannot occur. A leading word edge is tested after the first
# character, so that the engine rejects most positions on one comparison.
FINGERPRINT_NOISE = (
    ("fenced code", ("```",), r"```[\s\S]*?```"),
    ("inline code", ("`",), r"`[^`]*`"),
    ("url", ("://",), r"h(?<!\wh)ttps?://" + NON_SPACE + "+"),
    ("uuid", ("-",), r"[0-9a-f](?<!\w[0-9a-f])[0-9a-f]{7}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}"
     r"-[0-9a-f]{12}" + EDGE),
    # Two or more segments. Possessive, because a repeated group that may backtrack recurses once
    # per segment and a long enough path would overflow the stack of the task.
    ("path", ("/", "\\"),
     r"(?:[A-Za-z]:)?[\\/](?:[\w.@-]++[\\/](?=[\w.@-]))++[\w.@-]++"),
    ("number", (), r"\d(?<!\w\d)[\d.,_-]*" + EDGE),
)
PREVIEW_LENGTH = 220


def normalized_text(text: Column) -> Column:
    """Lower-case letters and digits only, single-spaced, with code, links and numbers removed.

    "The same prompt asked again" survives another path, line number or pasted snippet.
    """
    out = F.lower(text)
    for _, needs, pattern in FINGERPRINT_NOISE:
        out = _without(out, needs, pattern)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def _without(text: Column, needs: tuple[str, ...], pattern: str) -> Column:
    if not needs:
        return F.regexp_replace(text, pattern, " ")

    def remove(t: Column) -> Column:
        possible = F.contains(t, F.lit(needs[0]))
        for literal in needs[1:]:
            possible = possible | F.contains(t, F.lit(literal))
        return F.when(possible, F.regexp_replace(t, pattern, " ")).otherwise(t)

    return let(text, remove)


def fingerprint(text: Column) -> Column:
    """Hash of the normalised text, or of the exact text when nothing is left of it."""
    return let(
        normalized_text(text),
        lambda n: F.sha2(F.when(n != "", n).otherwise(F.concat(F.lit("exact:"), strip(text))), 256),
    )


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def collapsed(text: Column) -> Column:
    """White space runs as single spaces, none at the ends.

    In plain ASCII, where six signs are white space, single spaces are passed over.
    """
    ascii_only = F.octet_length(text) == F.length(text)
    return F.trim(
        F.when(ascii_only, F.regexp_replace(text, r" [\t-\r ]++|[\t-\r][\t-\r ]*+", " "))
        .otherwise(F.regexp_replace(text, SPACE + "+", " "))
    )


def words_in(flat: Column) -> Column:
    """Words of collapsed text: one more than its spaces, none when empty."""
    spaces = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", 0).otherwise(spaces + 1)


def word_count(text: Column) -> Column:
    return let(collapsed(text), words_in)


def shortened(flat: Column, max_length: int = PREVIEW_LENGTH) -> Column:
    return F.when(F.length(flat) <= max_length, flat).otherwise(
        F.concat(F.substring(flat, 1, max_length - 1), F.lit("…"))
    )


def preview(text: Column, max_length: int = PREVIEW_LENGTH) -> Column:
    return let(collapsed(text), lambda flat: shortened(flat, max_length))


def extension_of_path(path: Column) -> Column:
    """Lower-cased file extension at the very end of a path, null when there is none."""
    return F.nullif(F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})\z", 1)), F.lit(""))


def extensions_in(text: Column) -> Column:
    """Distinct file extensions mentioned in raw text.

    One match per run of path characters. Anchoring the match at the start of a run keeps the
    scan linear in the text, where an unanchored one restarts at every character of a long blob.
    Text without any ending, as most prose, is not scanned for runs.
    """
    run = r"[\w./\\@-]"
    ending = r"\.([A-Za-z0-9]{1,8})(?!\w)"
    found = F.regexp_extract_all(text, F.lit(rf"(?<!{run}){run}*{ending}"), F.lit(1))
    return F.when(text.rlike(ending), F.array_distinct(F.transform(found, F.lower))).when(
        text.isNotNull(), F.array().cast("array<string>")
    )


def split_list(value: Column) -> Column:
    """Distinct non-empty items of a comma-separated list, first occurrence first."""
    return F.when(
        value.isNotNull(), F.array_distinct(F.filter(F.split(value, ","), lambda x: x != ""))
    ).otherwise(F.array().cast("array<string>"))


def _accent_folding() -> tuple[str, str]:
    """Every precomposed letter whose canonical decomposition is one base letter plus marks."""
    source, target = [], []
    for code in range(0xC0, 0x2000):
        if code >= sys.maxunicode:
            break
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        base = [p for p in parts if not unicodedata.combining(p)]
        if len(parts) > 1 and len(base) == 1:
            source.append(char)
            target.append(base[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_folding()


def fold(text: Column) -> Column:
    """Case and diacritics removed, for search."""
    lowered = F.regexp_replace(F.lower(text), r"[\x{300}-\x{36F}]", "")
    return F.translate(lowered, _ACCENTED, _PLAIN)


def searchable(text: Column) -> Column:
    """Folded tokens joined by single spaces, with one leading space.

    A query token is a prefix of some text token exactly when ``' ' + token`` occurs here.
    """
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " ")))
