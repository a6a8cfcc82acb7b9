"""SimHash near-dedup with Golay-code fuzzy keys.

The perfect binary Golay code puts each of the 2 ** 23 words of 23 bits within 3 bits of exactly one
of 4,096 code words. The *near indices* of a word are the code words of itself and of all words one
bit away, one or six of them; a word within one bit of it therefore has its own index among them.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Up to 3 differing bits fall, by the
pigeonhole principle, in one of two ways:

* some segment is equal and another differs in one bit at most: key (equal segment, index of the
  other), near indices on one side;
* each segment differs in exactly one bit: key (index, index, index), near indices of the first two
  on one side and of the third on the other.

So every linked pair meets under at least one key, which holds 33 bits or more. Fingerprints that
meet are compared in full.

At similarity 0.8 about 10 of the 64 bits differ, and keys of so few bits would pair everything. For a
least similarity, fingerprints that meet under a key give the first candidates, up to WIDE bits apart;
every pair is verified, and an exact join of the sets of shingles (``similar``) finds what is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import permutations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similar
from .common import keep_rows, lookup, merged, read, stage
from .components import components
from .registry import query

#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 3
SHINGLE = 3
#: Fingerprints that meet are looked at up to so many differing bits where similarity is verified.
WIDE = 14
SEED = 42
#: A key's members are compared in blocks of about so many on each side.
BLOCK = 2048
#: Pairs compared at once inside a task.
PAIRS = 1 << 18

_decoded: list[np.ndarray] = []


def golay_indices() -> np.ndarray:
    """The code-word index, 0 to 4095, of every word of 23 bits."""
    if not _decoded:
        message = np.arange(4096, dtype=np.uint32)
        rest = message << 11
        for bit in range(22, 10, -1):
            rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
        code = message << 11 | rest
        table = np.zeros(1 << 23, dtype=np.uint16)
        one = [1 << i for i in range(23)]
        errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]),
                  *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
        for error in errors:
            table[code ^ np.uint32(error)] = message
        _decoded.append(table)
    return _decoded[0]


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8",
                             count=len(words) - shingle + 1)
    return similar.print_of(hashes)


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64 bits as a signed number."""
    @F.pandas_udf(T.LongType())
    def fingerprints(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, shingle) for t in texts], dtype=np.uint64).view(np.int64))

    return fingerprints(F.encode(text.cast("string"), "UTF-8"))


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of the distinct values in each row of a matrix."""
    values = np.sort(values, axis=1)
    fresh = np.ones(values.shape, dtype=bool)
    fresh[:, 1:] = values[:, 1:] != values[:, :-1]
    row, _ = np.nonzero(fresh)
    return row, values[fresh].astype(np.int64)


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of some fingerprints (uint64): row, key, role. Role 1 asks, 2 answers, 3 does both."""
    table = golay_indices()
    seg = [(prints >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    centre = [table[s].astype(np.int64) for s in seg]
    near = []
    for s, (_, width) in zip(seg, SEGMENTS):
        flips = np.array([0, *(1 << b for b in range(width))], dtype=np.int64)
        near.append(_unique(table[s[:, None] ^ flips[None, :]]))
    rows, keys, roles = [], [], []
    for kind, (equal, other) in enumerate(permutations(range(3), 2)):
        row, index = near[other]
        rows.append(row)
        keys.append(kind << 60 | seg[equal][row] << 12 | index)
        roles.append(np.where(index == centre[other][row], 3, 1))
    # Near indices of the first two segments, all combinations of a fingerprint's own.
    (ra, a), (rb, b) = near[0], near[1]
    count = np.bincount(rb, minlength=len(prints))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    times = count[ra]
    at = np.repeat(np.arange(len(ra)), times)
    step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    row, ia = ra[at], a[at]
    ib = b[first[row] + step]
    rows.append(row)
    keys.append(6 << 60 | ia << 24 | ib << 12 | centre[2][row])
    roles.append(np.where((ia == centre[0][row]) & (ib == centre[1][row]), 3, 1))
    row, ic = near[2]
    own = ic != centre[2][row]
    row, ic = row[own], ic[own]
    rows.append(row)
    keys.append(6 << 60 | centre[0][row] << 24 | centre[1][row] << 12 | ic)
    roles.append(np.full(len(row), 2))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(roles)


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        prints = batch["fp"].to_numpy()
        for start in range(0, len(prints), 4096):
            part = prints[start:start + 4096]
            row, key, role = fuzzy_keys(part.view(np.uint64))
            yield pd.DataFrame({"key": key, "role": role.astype(np.int32), "fp": part[row]})


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties every node of some links to the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, label[a], low)
        np.minimum.at(fresh, label[b], low)
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            break
        label = fresh
    tied = label != np.arange(len(nodes))
    return nodes[tied], nodes[label[tied]]


def closest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of each a, that with the fewest differing bits and that with the smallest b."""
    found = []
    for sort in ((b, np.bitwise_count(a ^ b), a), (b, a)):
        order = np.lexsort(sort)
        fresh = np.ones(len(order), dtype=bool)
        fresh[1:] = a[order][1:] != a[order][:-1]
        found.append(order[fresh])
    at = np.unique(np.concatenate(found))
    return a[at], b[at]


def _links_of(asks: np.ndarray, answers: np.ndarray, ask_of: np.ndarray, answer_from: np.ndarray,
              answer_n: np.ndarray, distance: int = DISTANCE, reduce=forest) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Compares each asking row with the answering rows of its group, some pairs at a time."""
    total = np.cumsum(answer_n[ask_of])
    start = 0
    while start < len(asks):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        group = ask_of[start:end]
        times = answer_n[group]
        left = np.repeat(asks[start:end], times)
        step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        right = answers[np.repeat(answer_from[group], times) + step]
        near = (left != right) & (np.bitwise_count(left ^ right) <= distance)
        if near.any():
            yield reduce(left[near].view(np.int64), right[near].view(np.int64))
        start = end


def _compare(batches: Iterator[pd.DataFrame], distance: int = DISTANCE, reduce=forest) -> Iterator[pd.DataFrame]:
    """Links of rows sorted by (key, ask_block, answer_block), of which each set is a group; ``reduce``
    takes those of some groups and leaves as many as there are rows or fewer."""
    held: pd.DataFrame | None = None

    def links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        where = rows[["key", "ask_block", "answer_block"]].to_numpy()
        group = np.concatenate([[0], np.cumsum((where[1:] != where[:-1]).any(axis=1))])
        asking = rows["asks"].to_numpy()
        prints = rows["fp"].to_numpy().view(np.uint64)
        n = np.bincount(group[~asking], minlength=group[-1] + 1)
        found = list(_links_of(prints[asking], prints[~asking], group[asking], np.cumsum(n) - n, n, distance, reduce))
        if found:
            u, v = reduce(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
            yield pd.DataFrame({"u": u, "v": v})

    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        where = rows[["key", "ask_block", "answer_block"]].to_numpy()
        last = int(np.argmax((where == where[-1]).all(axis=1)))  # the last group may go on
        held = rows.iloc[last:]
        if last:
            yield from links(rows.iloc[:last])
    if held is not None and len(held):
        yield from links(held)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints that connect all those linked directly or in a chain.

    ``prints`` has a column fp without repeats. Keys that only one fingerprint has are dropped by an
    aggregation before anything is compared. A key's members are dealt over blocks by hash and each
    pair of blocks is compared in a group of its own, so a crowded key is spread over tasks; a
    group hands on a tree of each component in it, never its pairs. The keys hold for a distance of
    3 at most.
    """
    if distance > DISTANCE:
        raise ValueError(f"keys find pairs of {DISTANCE} differing bits at most")
    return _meeting(prints, distance, forest)


def _meeting(prints: DataFrame, distance: int, reduce) -> DataFrame:
    """What ``reduce`` leaves of the pairs (u, v) under each key that are within the distance."""
    keys = prints.mapInPandas(_key_rows, "key long, role int, fp long")
    asks, answers = F.col("role").bitwiseAND(1) > 0, F.col("role") > 1
    shared = (
        keys.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.count(F.when(asks, 1)).alias("ask_n"),
             F.count(F.when(answers, 1)).alias("answer_n"))
        .where("n > 1 AND ask_n > 0 AND answer_n > 0")
        .select("key", F.expr(f"cast(1 + ask_n div {BLOCK} as int)").alias("ask_blocks"),
                F.expr(f"cast(1 + answer_n div {BLOCK} as int)").alias("answer_blocks"))
    )
    met = keys.join(merged(shared), "key")

    def side(mine: str, other: str, asking: bool) -> DataFrame:
        own = F.pmod(F.xxhash64("fp", "key"), F.col(f"{mine}_blocks")).cast("int")
        return met.where(asks if asking else answers).select(
            "key", "fp", F.lit(asking).alias("asks"), own.alias(f"{mine}_block"),
            F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(f"{other}_block"),
        )

    both = side("ask", "answer", True).unionByName(side("answer", "ask", False))
    place = ["key", "ask_block", "answer_block"]
    return (
        both.repartition(*place).sortWithinPartitions(*place)
        .select(*place, "asks", "fp").mapInPandas(partial(_compare, distance=distance, reduce=reduce), "u long, v long")
    )


def candidates(known: DataFrame) -> DataFrame:
    """Stored: distinct pairs (a, b) of sets whose SimHash prints are equal or meet under a fuzzy key.

    ``known`` has a set's fp and print. Sets of one print are paired with the first of them; a print
    is paired with the closest of those it meets and with the smallest, so pairs are no more than a
    few for each set, however large a group of near copies is.
    """
    prints = stage(known.groupBy("print").agg(F.min("fp").alias("fp")))
    same = lookup(known.select("print", F.col("fp").alias("b")), prints.withColumnRenamed("fp", "a"), "print", "b")
    met = _meeting(prints.select(F.col("print").alias("fp")), WIDE, closest)
    ends = met.groupBy("u").agg(F.min(F.struct(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).alias("bits"), "v")).alias(
        "close"), F.min("v").alias("low")).select("u", F.explode(F.array("close.v", "low")).alias("v"))
    named = ends.join(merged(prints.toDF("u", "a")), "u").join(merged(prints.toDF("v", "b")), "v")
    return stage(same.select("a", "b").unionByName(named.select("a", "b")).where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = similar.SHINGLE,
                    distance: int | None = None, least: tuple[int, int] = similar.LEAST) -> DataFrame:
    """One row per document: doc_id, body_hash, fp, root (of its component) and component_id.

    Without a ``distance`` two documents link if the Jaccard similarity of their sets of shingles of
    ``shingle`` words is ``least`` or more, every pair verified, and fp tells the set: SimHash prints
    of the sets give candidates, and an exact join what they leave apart. With one,
    SimHash fingerprints fp link at ``distance`` or fewer differing bits, 3 at most, and ``least``
    is not looked at.

    A component is all that is linked directly or in a chain, and component_id the smallest id in
    it. Equal fp are one node, so copies cost nothing beyond their own rows. A text without words,
    null included, has no shingles or fingerprint zero and is equal to any other such text. Null
    ids are passed over when the smallest is sought; a component of null ids only has component_id
    null. An empty table gives an empty result; other columns are not looked at.
    """
    if distance is None:
        rows = similar.sets_of(docs, doc_id, text, shingle, least)
    else:
        body = F.col(f"`{text}`")
        rows = stage(docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("body_hash"),
            fingerprint(body, shingle).alias("fp"),
        ))
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    if distance is None:
        known = similar.distinct_sets(rows)
        edges = similar.links(rows, known, candidates(known), docs, text, shingle, least)
    else:
        edges = links(prints.select("fp"), distance)
    roots = components(edges).withColumnRenamed("node", "fp")
    rooted = prints.join(merged(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least_id = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = lookup(rooted.select("fp", "root"), least_id, "root", "fp")
    return lookup(rows.select("doc_id", "body_hash", "fp"), named, "fp", "doc_id").select(
        "doc_id", "body_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = similar.SHINGLE,
                distance: int | None = None, least: tuple[int, int] = similar.LEAST) -> DataFrame:
    """The documents that stay: of each component the row with the smallest id.

    Returns rows of ``docs`` with all their columns. Null ids come after all others; rows that
    repeat id and text stay once.
    """
    found = near_duplicates(docs, doc_id, text, shingle, distance, least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body_hash")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.body_hash")
    return keep_rows(docs, first, doc_id, text, once=True)


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=SHINGLE, distance=DISTANCE).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
