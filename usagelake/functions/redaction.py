"""Secret redaction as column expressions over whole texts."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.functions.exprs import EDGE, let
from usagelake.rules.secrets import PLACEHOLDER, REDACTED_PREFIX, SECRET_RULES, SecretRule

# Noncharacters: they cannot occur in exchanged text, so they can bracket a candidate secret.
_OPEN, _CLOSE = "﷐", "﷑"
# Stand for an escaped backslash and an escaped quote while a JSON document is cut.
_SLASH, _QUOTE = "\ufdd2", "\ufdd3"

RESULT = "struct<text:string,count:int,kinds:array<string>>"


def _java(pattern: str) -> str:
    return pattern.replace(r"\b", EDGE)


def _mentions(text: Column, rule: SecretRule) -> Column:
    """Cheap test every text with a match passes."""
    target = F.lower(text) if rule.ignore_case else text
    tests = [F.contains(target, F.lit(h)) for h in rule.hints]
    return reduce(lambda a, b: a | b, tests)


def _applying(rule: SecretRule):
    return lambda state: _apply(state, rule).cast(RESULT)


def _apply(state: Column, rule: SecretRule) -> Column:
    """One rule: bracket every candidate, release the placeholders, replace the rest.

    Bracketing first makes the scan consume exactly the text a match spans, whether or not its
    value turns out to be a placeholder.
    """
    flags = "(?i)" if rule.ignore_case else ""
    before = rule.anchored or rule.before
    pattern = f"{flags}({_java(before)})({_java(rule.secret)})({_java(rule.after)})"
    text = state["text"]
    marked = F.regexp_replace(text, pattern, f"$1{_OPEN}$2{_CLOSE}$3")
    if rule.before:
        spared = f"(?i){_OPEN}((?:{PLACEHOLDER})|{re.escape(REDACTED_PREFIX)}[^{_CLOSE}]*){_CLOSE}"
        marked = F.regexp_replace(marked, spared, "$1")

    def settle(m: Column) -> Column:
        hits = F.length(m) - F.length(F.replace(m, F.lit(_OPEN), F.lit("")))
        replaced = F.regexp_replace(
            m, f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", f"{REDACTED_PREFIX}{rule.kind}]"
        )
        kinds = F.when(
            hits > 0, F.array_append(state["kinds"], F.lit(rule.kind))
        ).otherwise(state["kinds"])
        return F.struct(
            replaced.alias("text"),
            (state["count"] + hits).cast("int").alias("count"),
            kinds.alias("kinds"),
        )

    return F.when(_mentions(text, rule), let(marked, settle)).otherwise(state)


def redact(text: Column, rules=SECRET_RULES) -> Column:
    """``struct(text, count, kinds)`` with every secret replaced; null text stays null.

    A text without any hint is not shown to the rules: none of them would change it.
    """
    untouched = F.struct(
        text.alias("text"),
        F.lit(0).cast("int").alias("count"),
        F.array().cast("array<string>").alias("kinds"),
    ).cast(RESULT)
    state = untouched
    for rule in rules:
        state = let(state, _applying(rule))
    return F.when(_worth_reading(text, rules), state).otherwise(untouched)


# Letters and signs from common to rare in prose; what is not named is rarer still.
_COMMON = " etaoinsrhldcumfpgwybvkxjqz-:_/"


def hint_pattern(rules) -> str:
    """Pattern of all hints in lower case, each found by its rarest character.

    The scan stops at a few characters of a text only, however many hints there are.
    """
    def alternative(hint: str) -> tuple[str, str]:
        at = max(range(len(hint)), key=lambda i: (_COMMON + hint[i]).index(hint[i]))
        behind = f"(?<={re.escape(hint[:at + 1])})" if at else ""
        return hint[at], behind + re.escape(hint[at + 1:])

    found: dict[str, list[str]] = {}
    for hint in dict.fromkeys(h.lower() for r in rules for h in r.hints):
        rarest, rest = alternative(hint)
        found.setdefault(rarest, []).append(rest)
    first = "".join(re.escape(c) for c in found)
    return f"(?=[{first}])(?:" + "|".join(
        f"{re.escape(c)}(?:{'|'.join(rests)})" for c, rests in found.items()
    ) + ")"


def _worth_reading(text: Column, rules) -> Column:
    """Whether any hint occurs; lower case on both sides passes every text with a match."""
    return F.lower(text).rlike(hint_pattern(rules))


def _leaves(document: Column, clean) -> Column:
    """Apply ``clean`` to every string value of a JSON document, at any depth, keys left alone.

    Escaped signs are set aside, so that a string literal ends at the next quote; a literal that a
    colon follows is a key. Literals are decoded and encoded by the JSON functions themselves.
    """
    hidden = F.replace(F.replace(document, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    literal = '"[^"]*"'
    parts = F.arrays_zip(
        F.split(hidden, literal, -1).alias("between"),
        F.regexp_extract_all(hidden, F.lit(literal), F.lit(0)).alias("literal"),
        F.slice(F.split(hidden, literal, -1), 2, 2**31 - 1).alias("after"),
    )

    def part(p: Column) -> Column:
        shown = F.replace(F.replace(p["literal"], F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))

        def decoded(raw: Column) -> Column:
            text = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]
            return let(clean(text), lambda c: F.when(
                c["count"] > 0, F.regexp_replace(F.to_json(F.array(c["text"])), r"^\[|\]$", "")
            ).otherwise(raw))

        value = F.when(p["after"].rlike(r"^\s*:"), shown).otherwise(let(shown, decoded))
        return F.concat(p["between"], F.coalesce(value, F.lit("")))

    return F.array_join(F.transform(parts, part), "")


def redact_json(metadata: Column, rules=SECRET_RULES) -> Column:
    """Redact every string value of a JSON document, however deep; other text is redacted whole.

    Only documents that mention some credential hint are taken apart; the rest stay as they are.
    """
    def cleaned(text: Column) -> Column:
        return redact(text, rules)

    valid = F.try_parse_json(metadata).isNotNull()
    redacted = F.when(valid, _leaves(metadata, cleaned)).otherwise(cleaned(metadata)["text"])
    return F.when(_worth_reading(metadata, rules), redacted).otherwise(metadata)
