"""Intent, technology and task-area detection as column expressions.

All three read the normalised text. The text's tokens are looked up in the set of single-word
terms (linear in the text, whatever the size of the rule tables); the few multi-word terms are
substring tests on the padded text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagelake.contract import CLASSIFIER_VERSION, TASK_CONTEXTS
from usagelake.functions.exprs import js_round, let, string_array
from usagelake.functions.text import extensions_in, normalized_text
from usagelake.rules import intent, technology

CLASSIFICATION = "struct<category:string,confidence:double,version:int>"
DETECTIONS = "array<struct<name:string,confidence:double>>"


LEXICON_TERMS = tuple(t for _, _, terms in intent.LEXICONS for t in terms)
ALIASES = tuple(a for t in technology.TECHNOLOGIES for a in t.aliases)
AREA_TERMS = tuple(t for _, terms in technology.CONTEXT_TERMS for t in terms)
ALL_TERMS = tuple(dict.fromkeys((*LEXICON_TERMS, *ALIASES, *AREA_TERMS)))


def _among(items: Column, terms) -> Column:
    """Items that are one of the terms, in their order.

    Each item is looked up in a set that is built when planned; an intersection of arrays would
    build the set of all terms again for every row.
    """
    known = list(dict.fromkeys(terms))
    return F.filter(items, lambda item: item.isin(known))


def _any_among(items: Column, terms) -> Column:
    known = list(dict.fromkeys(terms))
    return F.exists(items, lambda item: item.isin(known))


def term_hits(normalized: Column, terms=ALL_TERMS) -> Column:
    """Distinct terms that occur in the normalised text as whole words.

    One look at each of the text's tokens answers the single words. A phrase is searched for
    only when its longest word is among the tokens, which leaves few substring searches per text.
    """
    terms = list(dict.fromkeys(terms))
    words = [t for t in terms if " " not in t]
    phrases = [t for t in terms if " " in t]
    keys = [max(t.split(" "), key=len) for t in phrases]
    tokens = F.split(normalized, " ")
    if not phrases:
        return F.array_distinct(_among(tokens, words))
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    spaced, leading = string_array([f" {t} " for t in phrases]), string_array(keys)

    def search(state: Column) -> Column:
        found = F.when(_any_among(state["present"], keys), F.filter(
            spaced,
            lambda t, i: F.array_contains(state["present"], F.get(leading, i))
            & F.contains(state["padded"], t),
        )).otherwise(F.array().cast("array<string>"))
        return F.concat(
            _among(state["present"], words),
            F.transform(found, lambda t: F.trim(t)),
        )

    present = F.array_distinct(_among(tokens, words + keys))
    return let(F.struct(present.alias("present"), padded.alias("padded")), search)


def _lexicon_scores(hits: Column) -> list[Column]:
    return [
        F.size(_among(hits, terms)) * F.lit(weight)
        for _, weight, terms in intent.LEXICONS
    ]


def _verb_head(normalized: Column) -> Column:
    """Index of the first opening verb that matches, or -1.

    Every opening is anchored at the start and at most four words long, so the first four words
    decide it, however long the text.
    """

    def first(opening: Column) -> Column:
        out = F.lit(-1)
        for index in range(len(intent.VERB_HEADS) - 1, -1, -1):
            out = F.when(opening.rlike(intent.VERB_HEADS[index][2]), index).otherwise(out)
        return out

    return let(F.substring_index(normalized, " ", 4), first)


def intent_scores(
    normalized: Column, tools: Column | None = None, hits: Column | None = None
) -> Column:
    """Scored categories of a normalised text, best first: ``array<struct<category,score>>``.

    ``hits`` are the text's rule terms where the caller already has them.

    Evidence comes from the lexicons, then the opening verb, then the tools that ran; a category
    that scores first wins a tie.
    """
    order = [category for category, _, _ in intent.LEXICONS]
    # A category a lexicon left at zero takes its place when the verb or a tool first scores it.
    lexicon_rank = {category: i for i, category in enumerate(order)}
    verb_rank = len(order)
    tool_rank = verb_rank + 1

    def score(n: Column) -> Column:
        def with_hits(found: Column) -> Column:
            return let(
                F.array(*_lexicon_scores(found)),
                lambda lexicon: let(_verb_head(n), lambda verb: assemble(lexicon, verb)),
            )

        return let(hits if hits is not None else term_hits(n, LEXICON_TERMS), with_hits)

    def assemble(lexicon: Column, verb: Column) -> Column:
        entries = []
        for category in order:
            from_lexicon = lexicon[lexicon_rank[category]]
            verb_ids = [i for i, row in enumerate(intent.VERB_HEADS) if row[0] == category]
            from_verb = F.lit(0)
            for i in verb_ids:
                from_verb = F.when(verb == i, intent.VERB_HEADS[i][1]).otherwise(from_verb)
            signals = [
                (i, row) for i, row in enumerate(intent.TOOL_SIGNALS) if row[0] == category
            ]
            from_tools, first_tool = F.lit(0), F.lit(None).cast("int")
            if tools is not None:
                for i, (_, weight, any_of, none_of) in reversed(signals):
                    fired = _any_among(tools, any_of)
                    if none_of:
                        fired = fired & ~_any_among(tools, none_of)
                    fired = F.coalesce(fired, F.lit(False))
                    from_tools = from_tools + F.when(fired, weight).otherwise(0)
                    first_tool = F.when(fired, tool_rank + i).otherwise(first_tool)
            rank = (
                F.when(from_lexicon > 0, lexicon_rank[category])
                .when(from_verb > 0, verb_rank)
                .otherwise(first_tool)
            )
            entries.append(
                F.struct(
                    (-(from_lexicon + from_verb + from_tools)).cast("int").alias("neg_score"),
                    rank.cast("int").alias("rank"),
                    F.lit(category).alias("category"),
                )
            )
        scored = F.filter(F.array(*entries), lambda e: e["neg_score"] < 0)
        return F.transform(
            F.sort_array(scored),
            lambda e: F.struct(
                e["category"].alias("category"), (-e["neg_score"]).alias("score")
            ),
        )

    return let(normalized, score)


def outcome(scores: Column, floor: float = intent.CONFIDENCE_FLOOR) -> Column:
    """Category and confidence from scored categories, best first."""

    def decide(s: Column) -> Column:
        best = F.try_element_at(s, F.lit(1))["score"]
        second = F.try_element_at(s, F.lit(2))["score"]
        total = F.aggregate(s, F.lit(0), lambda acc, e: acc + e["score"])
        dominance = best / total
        margin = F.coalesce((best - second) / best, F.lit(1.0))
        evidence = F.least(F.lit(1.0), best / 10.0)
        raw = dominance * 0.5 + margin * 0.25 + evidence * 0.25
        return js_round(F.least(F.lit(1.0), raw) * 100.0) / 100.0

    def named(s: Column) -> Column:
        return F.when(
            F.size(s) > 0,
            let(
                decide(s),
                lambda c: F.struct(
                    F.when(c < floor, F.lit("Other"))
                    .otherwise(F.try_element_at(s, F.lit(1))["category"])
                    .alias("category"),
                    c.cast("double").alias("confidence"),
                    F.lit(CLASSIFIER_VERSION).alias("version"),
                ),
            ),
        ).otherwise(
            F.struct(
                F.lit("Other").alias("category"),
                F.lit(0.0).alias("confidence"),
                F.lit(CLASSIFIER_VERSION).alias("version"),
            )
        )

    return let(scores, named).cast(CLASSIFICATION)


def classify(text: Column, tools: Column | None = None) -> Column:
    """Default classifier; any callable of the same shape can take its place."""
    return classify_normalized(normalized_text(F.coalesce(text, F.lit(""))), tools)


def classify_normalized(
    normalized: Column, tools: Column | None = None, hits: Column | None = None
) -> Column:
    return outcome(intent_scores(normalized, tools, hits))


def detect_technologies(
    text: Column, project_technologies: Column | None = None,
    extra_extensions: Column | None = None, hits: Column | None = None,
) -> Column:
    """All technologies found, most certain first: ``array<struct<name,confidence>>``.

    ``hits`` are the text's rule terms where the caller already has them.
    """
    if hits is None:
        hits = term_hits(normalized_text(F.coalesce(text, F.lit(""))), ALIASES)
    extensions = extensions_in(F.coalesce(text, F.lit("")))
    if extra_extensions is not None:
        extensions = F.concat(extensions, F.transform(extra_extensions, F.lower))
    known = F.coalesce(project_technologies, F.array().cast("array<string>")) if (
        project_technologies is not None
    ) else F.array().cast("array<string>")

    def rank(hits: Column, exts: Column) -> Column:
        named = []
        for entry in technology.TECHNOLOGIES:
            seen = F.when(
                _any_among(hits, entry.aliases),
                F.lit(technology.ALIAS_CONFIDENCE),
            )
            if entry.extensions:
                seen = F.coalesce(
                    seen,
                    F.when(
                        _any_among(exts, entry.extensions),
                        F.lit(technology.EXTENSION_CONFIDENCE),
                    ),
                )
            named.append(F.struct(seen.alias("confidence"), F.lit(entry.name).alias("name")))
        found = F.filter(F.array(*named), lambda e: e["confidence"].isNotNull())
        names = F.transform(found, lambda e: e["name"])
        added = F.transform(
            F.array_except(F.array_distinct(known), names),
            lambda n: F.struct(
                F.lit(technology.PROJECT_CONFIDENCE).alias("confidence"), n.alias("name")
            ),
        )
        keyed = F.transform(
            F.concat(found, added),
            lambda e: F.struct((-e["confidence"]).alias("neg"), e["name"].alias("name")),
        )
        top = F.sort_array(keyed)
        return F.transform(
            top, lambda e: F.struct(e["name"].alias("name"), (-e["neg"]).alias("confidence"))
        )

    # Only the handful of aliases and extensions that occur are compared with each technology.
    known_ext = [e for t in technology.TECHNOLOGIES for e in t.extensions]
    return let(
        F.struct(
            _among(hits, ALIASES).alias("hits"),
            _among(extensions, known_ext).alias("exts"),
        ),
        lambda s: F.when(
            (F.size(s["hits"]) + F.size(s["exts"]) + F.size(known)) > 0, rank(s["hits"], s["exts"])
        ).otherwise(F.array().cast(DETECTIONS)),
    ).cast(DETECTIONS)


def detect_contexts(
    normalized: Column, technologies: Column, hits: Column | None = None
) -> Column:
    """Task areas of a normalised text with their share of the evidence."""
    by_context = {
        context: [t.name for t in technology.TECHNOLOGIES if context in t.contexts]
        for context in TASK_CONTEXTS
    }
    most_areas = max(len(t.contexts) for t in technology.TECHNOLOGIES)

    def implied_rank(context: str) -> Column:
        """Position of the first technology that brings this area up."""

        def position(tech: Column, index: Column) -> Column:
            out = F.lit(None).cast("int")
            for place in range(most_areas):
                names = [
                    t.name for t in technology.TECHNOLOGIES
                    if len(t.contexts) > place and t.contexts[place] == context
                ]
                if names:
                    out = F.when(tech["name"].isin(names), index * most_areas + place).otherwise(out)
            return out

        return F.array_min(F.transform(technologies, position)) + len(technology.CONTEXT_TERMS)

    def shares(hits: Column) -> Column:
        entries = []
        for place, (context, context_terms) in enumerate(technology.CONTEXT_TERMS):
            from_terms = F.size(_among(hits, context_terms))
            names = by_context[context]
            from_tech = F.aggregate(
                F.filter(technologies, lambda t: t["name"].isin(names)),
                F.lit(0.0),
                lambda acc, t: acc + t["confidence"],
            )
            entries.append(
                F.struct(
                    (from_terms + from_tech).cast("double").alias("score"),
                    # Areas named in the text come before areas only implied by technologies.
                    F.when(from_terms > 0, place)
                    .otherwise(implied_rank(context)).cast("int").alias("rank"),
                    F.lit(context).alias("name"),
                )
            )
        scored = let(F.filter(F.array(*entries), lambda e: e["score"] > 0), ranked)
        # No evidence, no area.
        return F.when(F.size(hits) + F.size(technologies) > 0, scored)

    def ranked(scored: Column) -> Column:
        total = F.aggregate(scored, F.lit(0.0), lambda acc, e: acc + e["score"])

        def over(t: Column) -> Column:
            rounded = F.transform(
                scored,
                lambda e: F.struct(
                    (-(js_round(e["score"] / t * 100.0) / 100.0)).alias("neg"),
                    e["rank"].alias("rank"),
                    e["name"].alias("name"),
                ),
            )
            kept = F.filter(rounded, lambda e: -e["neg"] >= technology.CONTEXT_FLOOR)
            top = F.sort_array(kept)
            return F.transform(
                top, lambda e: F.struct(e["name"].alias("name"), (-e["neg"]).alias("confidence"))
            )

        return let(total, over)

    found = let(hits if hits is not None else term_hits(normalized, AREA_TERMS), shares)
    return F.coalesce(found, F.array().cast(DETECTIONS)).cast(DETECTIONS)
