"""Rule data of the intent classifier."""

from __future__ import annotations


def _terms(text: str) -> tuple[str, ...]:
    return tuple(t.strip() for t in " ".join(text.split()).split(",") if t.strip())


# Category, weight and whole-word terms, in scoring order.
LEXICONS = (
    ("Debugging", 3, _terms("""
        error, errors, bug, bugs, crash, crashes, crashing, failing, fails, returns undefined,
        instead of the, is empty but, but the query, only in production, failed, exception,
        traceback, stacktrace, stack trace, broken, not working, doesn t work, does not work,
        why is, why does, why doesn, debug, fix, fixing, undefined is not, null pointer, segfault,
        timeout, hangs, stuck, regression, reproduce, root cause, econnrefused, panic, nan,
        infinite loop""")),
    ("Implementation", 2, _terms("""
        implement, add a, add the, build, create, write a, write the, make a, generate, scaffold,
        wire up, hook up, integrate, support for, feature, endpoint, component, function that,
        method that, class that, set up, new page, new screen, new module""")),
    ("Code Review", 5, _terms("""
        review, code review, look over, critique, feedback on, pull request, pr, diff,
        is this correct, any issues, anything wrong, security review, best practice, code smell,
        audit, lgtm""")),
    ("Refactoring", 5, _terms("""
        refactor, clean up, cleanup, simplify, rename, extract, deduplicate, dry, restructure,
        reorganize, reorganise, tidy, modernize, modernise, migrate to, split into, split this,
        smaller modules, consolidate, reduce duplication""")),
    ("Explanation", 3, _terms("""
        explain, what does, what is, how does, walk me through, help me understand, meaning of,
        difference between, why would, when should, tell me about, clarify, summarize this code,
        what happens when""")),
    ("Research", 3, _terms("""
        research, find out, look up, search for, compare, options for, alternatives,
        which library, which framework, pros and cons, evaluate, investigate, is there a,
        recommend, best way to, state of the art, benchmark""")),
    ("Planning", 5, _terms("""
        plan, roadmap, milestone, break down, break this into, steps to, approach for, strategy,
        todo, backlog, estimate, sequence, phases, what should i do, next steps, prioritize,
        prioritise""")),
    ("Documentation", 5, _terms("""
        document, documentation, readme, docstring, jsdoc, comment the, add comments, changelog,
        api docs, write docs, usage guide, tutorial for, contributing guide""")),
    ("Testing", 5, _terms("""
        test, tests, unit test, integration test, e2e, end to end, coverage, vitest, jest, pytest,
        playwright, cypress, mock, stub, fixture, assertion, test case, snapshot test, flaky""")),
    ("DevOps", 5, _terms("""
        docker, dockerfile, kubernetes, k8s, helm, terraform, ansible, ci, cicd, ci cd, pipeline,
        github actions, gitlab ci, jenkins, deploy, deployment, nginx, systemd, swarm, container,
        aws, gcp, azure, cloudformation, monitoring, observability, load balancer, dns, ssl,
        certificate, environment variable, secrets manager, rollout""")),
    ("Architecture", 5, _terms("""
        architecture, architect, design pattern, system design, schema design, data model,
        should i use, trade off, tradeoff, scalability, microservice, monolith, event driven,
        separation of concerns, boundaries, layering, domain model, high level design""")),
    ("Writing", 5, _terms("""
        write a post, blog, email, copy for, marketing, announcement, release notes, proposal,
        rephrase, reword, tone, draft a, newsletter, landing page copy, commit message""")),
)

# Opening verbs, most specific first; only the first match counts.
VERB_HEADS = (
    ("Debugging", 6, r"^(?:fix|debug|troubleshoot|diagnose)\b"),
    ("Refactoring", 6, r"^(?:refactor|simplify|rename|restructure|deduplicate)\b"),
    ("DevOps", 6, r"^(?:deploy|dockerize|dockerise|containerize|containerise|provision)\b"),
    ("Code Review", 5, r"^(?:review|audit|critique)\b"),
    ("Research", 5, r"^(?:research|compare|evaluate|investigate|benchmark)\b"),
    ("Planning", 5, r"^(?:plan|outline|prioriti[sz]e|estimate)\b"),
    ("Documentation", 5, r"^(?:document|write docs|write documentation)\b"),
    ("Debugging", 4, r"^(?:why|whats wrong|what s wrong)\b"),
    ("Explanation", 4, r"^(?:explain|describe|clarify|walk me through|help me understand)\b"),
    ("Explanation", 3, r"^what (?:is|does|are the difference|happens|do)\b"),
    ("Explanation", 3, r"^how (?:does|do|can|should|would)\b"),
    ("Writing", 5, r"^(?:draft|reword|rephrase)\b"),
    ("Implementation", 4, r"^(?:implement|scaffold|integrate)\b"),
    ("Implementation", 2, r"^(?:add|build|create|make|write|generate|set up|wire)\b"),
)

# Category, weight, any of these tools, none of these tools.
TOOL_SIGNALS = (
    ("Implementation", 3, ("Edit", "Write", "NotebookEdit"), ()),
    ("Research", 4, ("WebSearch", "WebFetch"), ()),
    ("Research", 3, ("Read", "Grep"), ("Edit", "Write")),
    ("Planning", 2, ("TodoWrite",), ()),
)

# Fixed value: below this confidence the answer is "Other".
CONFIDENCE_FLOOR = 0.3
