"""Near-dedup by similarity: SimHash candidates first, the exact join for what they leave apart."""

from __future__ import annotations

import random

from tests.llm import data
from usagelake.llm import simhash, similar


def variants(changes: int, groups: int = 20, size: int = 400) -> list[str]:
    """Pairs of texts of which one has some words changed."""
    rng = random.Random(changes)
    out = []
    for group in range(groups):
        words = ["w%d_%d" % (group, rng.randrange(10 ** 6)) for _ in range(size)]
        other = list(words)
        for at in rng.sample(range(size), changes):
            other[at] = "x%d" % rng.randrange(10 ** 6)
        out += [" ".join(words), " ".join(other)]
    return out


def stored(spark, texts):
    docs = data.frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(3)
    sets = similar.sets_of(docs, "doc_id", "text", 5, (4, 5))
    return docs, sets, similar.distinct_sets(sets)


def test_simhash_finds_most_copies_that_differ_little(spark):
    _, sets, known = stored(spark, variants(1) + variants(60))
    of = {r["doc_id"]: r["fp"] for r in sets.collect()}
    found = {frozenset((r["a"], r["b"])) for r in simhash.candidates(known).collect()}
    assert sum(frozenset((of[2 * i], of[2 * i + 1])) in found for i in range(20)) >= 18
    assert len(found) <= 3 * len(of)


def test_candidates_carry_links_that_the_join_is_not_asked_for(spark, monkeypatch):
    """With the leading shingles of all sets withheld, what is linked was linked by SimHash."""
    docs, sets, known = stored(spark, variants(1))
    met = similar._met(sets)
    monkeypatch.setattr(similar, "_met", lambda sets: met.limit(0))
    edges = similar.links(sets, known, simhash.candidates(known), docs, "text", 5, (4, 5))
    assert edges.distinct().count() >= 18


def test_the_join_finds_what_simhash_leaves(spark):
    texts = variants(1) + variants(9)
    words = [t.split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]
    near = [5 * len(sets[2 * i] & sets[2 * i + 1]) >= 4 * len(sets[2 * i] | sets[2 * i + 1]) for i in range(40)]
    docs, rows, known = stored(spark, texts)
    none = simhash.candidates(known).limit(0)
    edges = similar.links(rows, known, none, docs, "text", 5, (4, 5))
    assert edges.distinct().count() == sum(near)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert [got[2 * i] == got[2 * i + 1] for i in range(40)] == near


def large(shared: int, changes: int, seed: int, size: int = 1500) -> list[str]:
    """Texts of more shingles than a field has bits, all with one passage; of each two, the second has
    some words changed."""
    rng = random.Random(seed)
    passage = ["p%d" % i for i in range(shared)]
    out = []
    for group in range(8):
        words = passage + ["g%d_%d" % (group, rng.randrange(10 ** 6)) for _ in range(size - shared)]
        other = list(words)
        for at in rng.sample(range(shared, size), changes):
            other[at] = "x%d" % rng.randrange(10 ** 6)
        out += [" ".join(words), " ".join(other)]
    return out


def test_wide_fields_tell_large_sets_apart(spark):
    """Sets of 3,000 shingles fill a field of 1,024 bits, so that any two seem alike; wide ones differ."""
    texts = [" ".join("%s%d" % (c, i) for i in range(n)) for c, n in (("a", 3000), ("b", 3000), ("c", 4500))]
    texts += [texts[0] + " end", texts[0].replace("a7 ", "z7 ")]
    # Sets of 4,093 and 4,200 shingles, one with half the bits of the other.
    texts += [" ".join("d%d" % i for i in range(n)) for n in (4097, 4204)]
    docs, rows, known = stored(spark, texts)
    fp = {r["fp"]: r["doc_id"] for r in rows.collect()}
    one, two = (known.select(*[known[c].alias(f"{s}_{c}") for c in ("fp", "n", "field", "wide")]) for s in "ab")
    pairs = one.crossJoin(two).where("a_fp < b_fp")
    least = (4, 5)

    def passed(where):
        return {tuple(sorted((fp[r["a_fp"]], fp[r["b_fp"]]))) for r in pairs.where(where).collect()}

    similar_ones = {(0, 3), (0, 4), (3, 4), (5, 6)}
    assert passed(similar._differ_little(least)) > similar_ones
    assert passed(similar._differ_little_wide(least) + " AND a_n * 5 >= b_n * 4 AND b_n * 5 >= a_n * 4") == similar_ones


def test_crowds_of_large_sets_keep_their_links(spark, monkeypatch):
    """Under crowded shingles, with all of them and with the first alone taken along."""
    monkeypatch.setattr(similar, "BLOCK", 4)
    texts = large(700, 20, 1) + large(700, 60, 2) + variants(1, groups=4)
    words = [t.split() for t in texts]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in words]
    near = {(i, j) for i in range(len(sets)) for j in range(i)
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    docs, rows, known = stored(spark, texts)
    fp = {r["doc_id"]: r["fp"] for r in rows.collect()}
    want = {frozenset((fp[i], fp[j])) for i, j in near}
    for crowded in (1, 64):
        monkeypatch.setattr(similar, "CROWDED", crowded)
        edges = similar.links(rows, known, simhash.candidates(known).limit(0), docs, "text", 5, (4, 5))
        assert {frozenset((r["u"], r["v"])) for r in edges.collect()} == want
