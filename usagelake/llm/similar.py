"""Exact similarity join of documents over their sets of shingles.

Candidates come first from SimHash prints of the sets that meet under fuzzy keys (``simhash``); what
they leave apart is looked for by an exact join, so that no similar pair is missed.

The shingles of a set are ordered by hash. Two sets of similarity ``LEAST`` or more share one of the
first n - ceil(LEAST n) + 1 shingles of each (prefix filter), differ little in size (length filter),
and can still reach the overlap after the first shingle they share (positional filter). A field of
FIELD bits, of which every shingle flips one, tells a least number of different shingles. What
passes is compared in full.

Only the components matter, so pairs of sets that are tied already are left out: after the candidates
of SimHash, every set is compared with one that is the first under most of its shingles, which ties nearly
all of a large group of near copies together, and then sets under one shingle that are still in different
components. Under shingles that lead many sets, a pair is made once, under the first of them that both have,
and sets larger than the field has bits are told apart by a field that grows with them.
Candidates are pairs of ids until the fields have been compared; only then are texts read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import lookup, merged, stage
from .components import components

#: Least similarity, as a fraction to keep sizes exact.
LEAST = (4, 5)
SHINGLE = 5
#: Longs of the field of a set.
FIELD = 16
#: Sets of more shingles, which would fill their field, have a wide one as well.
FULL = 64 * FIELD
#: The sets under a shingle are dealt over blocks of about so many.
BLOCK = 512
#: The crowded shingles that a set takes along, its first ones.
CROWDED = 64
_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
#: Bits of the field that holds back texts no candidate pair asks for: 2 MB.
ASKED = 1 << 24


def shingles_of(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the different shingles of a text, ascending; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), dtype=np.uint64))


def print_of(hashes: np.ndarray) -> int:
    """The SimHash of some 64-bit hashes: a bit is 1 if it is set in over half of them."""
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
    if len(hashes) < 256:
        ones = np.unpackbits(columns, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(columns[:, i], minlength=256) @ _BYTE for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def field_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Of so many bits, a power of 2, every hash flips one: an array of longs."""
    flips = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(bool), bitorder="little").view("<i8")


def prefix_of(n: int, least: tuple[int, int]) -> int:
    return n + (-least[0] * n // least[1]) + 1 if n else 0


def sets_of(docs: DataFrame, doc_id: str, text: str, shingle: int, least: tuple[int, int]) -> DataFrame:
    """Stored, one row per document: doc_id, body_hash, fp (told by the set), n, print (its SimHash),
    field, wide (a field of as many bits as shingles or more, null for sets up to FULL) and lead, the
    prefix of the set; the last four are null where the same batch has an equal set before."""
    key, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    narrow = docs.select(key.alias("doc_id"), F.xxhash64(body).alias("body_hash"),
                         F.encode(body.cast("string"), "UTF-8").alias("body"))
    schema = T.StructType([
        narrow.schema["doc_id"], T.StructField("body_hash", T.LongType()), T.StructField("fp", T.LongType()),
        T.StructField("n", T.IntegerType()), T.StructField("print", T.LongType()),
        T.StructField("field", T.ArrayType(T.LongType())),
        T.StructField("wide", T.ArrayType(T.LongType())),
        T.StructField("lead", T.ArrayType(T.LongType())),
    ])
    arrow = to_arrow_schema(schema)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, fp, n, prints, field, wide, lead = set(), [], [], [], [], [], []
            for value in batch.column(2):
                found = shingles_of(value.as_py(), shingle)
                fp.append(xxhash.xxh64_intdigest(found.tobytes()))
                n.append(len(found))
                if fp[-1] in seen:
                    prints.append(None)
                    field.append(None)
                    wide.append(None)
                    lead.append(None)
                    continue
                seen.add(fp[-1])
                prints.append(int(np.uint64(print_of(found)).view(np.int64)))
                field.append(field_of(found, FULL))
                wide.append(field_of(found, 1 << (len(found) - 1).bit_length()) if len(found) > FULL else None)
                lead.append(found[:prefix_of(len(found), least)].view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)),
                pa.array(n, pa.int32()), pa.array(prints, pa.int64()), pa.array(field, arrow.field("field").type),
                pa.array(wide, arrow.field("wide").type), pa.array(lead, arrow.field("lead").type),
            ], schema=arrow)

    return stage(narrow.mapInArrow(sets, schema))


def distinct_sets(sets: DataFrame) -> DataFrame:
    """Stored, one row per set: fp, n, print, field, wide and the body_hash of a text that has it."""
    return stage(sets.where("lead IS NOT NULL").groupBy("fp").agg(
        *[F.first(c).alias(c) for c in ("n", "print", "field", "wide", "body_hash")]))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, fp, n, at) sorted by key and fp: every set under a key behind the first, with it."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])
        carried = last is not None
        if carried:  # the first set of the last key, and the row before
            rows = np.concatenate([last, rows], axis=1)
        key, fp = rows[0], rows[1]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (fp[1:] == fp[:-1])])
        out = ~fresh & ~again
        if carried:
            out[:2] = False
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (key[out], *rows[1:, head[out]], *rows[1:, out])],
            names=["key", "a", "a_n", "a_at", "b", "b_n", "b_at"])
        last = np.stack([rows[:, head[-1]], rows[:, -1]], axis=1)


def _met(sets: DataFrame) -> DataFrame:
    """Stored: every set under a leading shingle behind the first, with it."""
    leads = sets.where("lead IS NOT NULL").select("fp", "n", F.posexplode("lead").alias("at", "key"))
    return stage(
        leads.select("key", "fp", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at"))
        .repartition("key").sortWithinPartitions("key", "fp")
        .mapInArrow(_meet, "key long, a long, a_n long, a_at long, b long, b_n long, b_at long")
    )


def _roots(pairs: DataFrame) -> DataFrame:
    return stage(components(pairs))


def _apart(pairs: DataFrame, roots: DataFrame, a: str, b: str) -> DataFrame:
    """The pairs whose ends are in different components."""
    one, two = (roots.toDF(end, f"{end}_root") for end in (a, b))
    return pairs.join(merged(one), a, "left").join(merged(two), b, "left").where(
        F.coalesce(f"{a}_root", a) != F.coalesce(f"{b}_root", b))


def _can_be(least: tuple[int, int]) -> str:
    """Length and positional filter for sets a and b under one shingle."""
    up, down = least
    return f"""a_n * {down} >= b_n * {up} AND b_n * {down} >= a_n * {up}
        AND least(a_n - a_at, b_n - b_at) * {up + down} >= (a_n + b_n) * {up}"""


def _can_share(least: tuple[int, int]) -> str:
    """Length filter, and what sets a and b can share before, at and after any shingle of both."""
    up, down = least
    return f"""a_n * {down} >= b_n * {up} AND b_n * {down} >= a_n * {up}
        AND (least(a_at, b_at) + least(a_n - a_at, b_n - b_at)) * {up + down} >= (a_n + b_n) * {up}"""


def _least_shared(least: tuple[int, int]) -> str:
    """The fewest leading shingles that similar sets a and b share. Up to the smaller of their last
    leading shingles, one set has its whole prefix, and what it does not share is all that the least
    overlap spares."""
    up, down = least
    return f"(({up} * (a_n + b_n) - 1) div {up + down}) + 2 - ((greatest(a_n, b_n) * {up} + {down - 1}) div {down})"


def _differ_little(least: tuple[int, int]) -> str:
    """Length filter and that of the fields for sets a and b."""
    up, down = least
    differ = " + ".join(f"bit_count(a_field[{i}] ^ b_field[{i}])" for i in range(FIELD))
    return f"""a_n * {down} >= b_n * {up} AND b_n * {down} >= a_n * {up}
        AND ({differ}) * {up + down} <= (a_n + b_n) * {down - up}"""


def _differ_little_wide(least: tuple[int, int]) -> str:
    """The filter of the fields for the wide ones of sets a and b, of which one can have twice the
    bits of the other: its halves are laid upon each other."""
    up, down = least

    def folded(one: str, other: str) -> str:
        half = f"size({other}_wide)"
        return f"""IF(size({one}_wide) > {half}, zip_with(slice({one}_wide, 1, {half}),
            slice({one}_wide, {half} + 1, {half}), (x, y) -> x ^ y), {one}_wide)"""

    differ = f"""aggregate(zip_with({folded("a", "b")}, {folded("b", "a")}, (x, y) -> bit_count(x ^ y)), 0,
        (total, bits) -> total + bits)"""
    return f"{differ} * {up + down} <= (a_n + b_n) * {down - up}"


def _possible(pairs: DataFrame, known: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Stored: the pairs (a, b) whose fields let them be similar."""
    one, two = (known.select(*[F.col(c).alias(n) for c, n in (("fp", s), ("n", f"{s}_n"), ("field", f"{s}_field"))])
                for s in "ab")
    return stage(lookup(lookup(pairs, one, "a", "b"), two, "b", "a").where(_differ_little(least)).select("a", "b"))


def _verified(pairs: DataFrame, known: DataFrame, docs: DataFrame, text: str, shingle: int,
              least: tuple[int, int]) -> DataFrame:
    """Stored: (u, v) of the distinct pairs (a, b) whose sets are similar, from the texts."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    bodies = known.join(merged(asked), "fp", "left_semi")
    field = np.zeros(ASKED, dtype=bool)
    slot = F.col("body_hash").bitwiseAND(ASKED - 1).cast("int").alias("slot")
    field[bodies.select(slot).distinct().toArrow().column("slot").to_numpy()] = True
    spread = docs.sparkSession.sparkContext.broadcast(np.packbits(field))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = spread.value
        for batch in batches:
            hashes = batch.column(0).to_numpy()
            at = hashes & (ASKED - 1)
            wanted = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)) & 1)
            _, first = np.unique(hashes[wanted], return_index=True)
            wanted = wanted[first]
            found = [shingles_of(batch.column(1)[int(i)].as_py(), shingle) for i in wanted]
            fp = np.array([xxhash.xxh64_intdigest(words.tobytes()) for words in found], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp.view(np.int64)), pa.array([words.view(np.int64) for words in found], pa.list_(pa.int64()))],
                names=["fp", "words"])

    body = F.col(f"`{text}`")
    words = docs.select(F.xxhash64(body), F.encode(body.cast("string"), "UTF-8")).mapInArrow(
        again, "fp long, words array<long>").groupBy("fp").agg(F.first("words").alias("words"))
    # Words go once to where their set is asked for, and from there once to each pair.
    ends = pairs.select("a", "b", F.xxhash64("a", "b").alias("pair"), F.explode(F.array("a", "b")).alias("fp"))
    one, two = (F.first(F.when(F.col("fp") == F.col(s), F.col("words")), ignorenulls=True).alias(f"{s}_words") for s in "ab")
    both, size = F.size(F.array_intersect("a_words", "b_words")), F.size("a_words") + F.size("b_words")
    return stage(lookup(ends, words, "fp", "pair").groupBy("a", "b").agg(one, two).where(
        both * (least[0] + least[1]) >= size * least[0]).select(F.col("a").alias("u"), F.col("b").alias("v")))


def links(sets: DataFrame, known: DataFrame, near: DataFrame, docs: DataFrame, text: str, shingle: int,
          least: tuple[int, int]) -> DataFrame:
    """Pairs (u, v) of distinct sets that connect all similar ones, directly or in a chain.

    ``known`` are the distinct sets, ``near`` the distinct pairs (a, b) that are looked at first.
    """
    told = _verified(near, known, docs, text, shingle, least)
    met = _met(sets)
    # Of the first sets it meets, each set is compared with the one it meets most often.
    often = met.where(_can_be(least)).groupBy("b", "a").agg(F.count(F.lit(1)).alias("times"))
    first = often.groupBy("b").agg(F.max(F.struct("times", "a")).alias("most")).select("most.a", "b")
    first = stage(_apart(first, _roots(told), "a", "b").select("a", "b"))
    tied = told.unionByName(_verified(_possible(first, known, least), known, docs, text, shingle, least))
    roots = _roots(tied)

    side = ["key", "fp", "n", "at"]
    rows = met.select("key", "b", "b_n", "b_at").toDF(*side).unionByName(
        met.select("key", "a", "a_n", "a_at").distinct().toDF(*side))
    rows = stage(rows.join(merged(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")))
    apart = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias(
        "rows")).where("low <> high").select("key", F.expr(f"cast(1 + rows div {BLOCK} as int)").alias("blocks"))
    open_ = rows.join(merged(apart), "key")
    # A key of one block makes few pairs; in a crowd fields go along, and the crowded keys of the set.
    few, many = open_.where("blocks = 1"), stage(open_.where("blocks > 1"))
    crowded = many.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("keys")).select(
        "fp", F.slice("keys.key", 1, CROWDED).alias("crowd"), (F.size("keys") <= CROWDED).alias("whole"))
    many = stage(lookup(many, known.select("fp", "field", "wide").join(merged(crowded), "fp"), "fp", "key"))
    a, b = (few.select("key", *[F.col(c).alias(f"{s}_{c}") for c in ("fp", "n", "at", "root")]) for s in "ab")
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    differ = "a_fp < b_fp AND a_root <> b_root AND " + _can_share(least)
    pair = [F.col("a_fp").alias("a"), F.col("b_fp").alias("b"), "a_n", "b_n", F.expr(_can_be(least)).alias("fits")]
    both = "array_intersect(a_crowd, b_crowd)"

    def in_crowd(sets: DataFrame, where: str) -> DataFrame:
        """Pairs of the sets under the first crowded key that both take along, else under each."""
        c, d = (
            sets.select("key", block.alias("block"), *[F.col(c).alias(f"{s}_{c}") for c in (
                "fp", "n", "at", "root", "field", "wide", "crowd", "whole")])
            for s, block in (("a", own), ("b", every))
        )
        once = f"coalesce(get({both}, 0), key) = key"
        return c.join(merged(d.withColumnRenamed("key", "b_key").withColumnRenamed("block", "b_block")), F.expr(
            f"key = b_key AND block = b_block AND {differ} AND {_differ_little(least)} AND {where} AND {once}")).select(
            *pair, F.expr(f"IF(a_whole AND b_whole, size({both}), a_n)").alias("shared"))

    up, down = least
    # Sets of different components meet under all the leading shingles they share.
    rest = a.join(merged(b), "key").where(differ).select(*pair, F.lit(1).alias("shared")).unionByName(
        in_crowd(many.where(f"n * {up} <= {FULL * down}"), f"least(a_n, b_n) <= {FULL}")
    ).unionByName(
        in_crowd(many.where(f"n > {FULL}"), _differ_little_wide(least))
    ).groupBy("a", "b", "a_n", "b_n").agg(F.sum("shared").alias("shared"), F.max("fits").alias("fits")).where(
        f"fits AND shared >= {_least_shared(least)}").select("a", "b")
    tried = near.unionByName(first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = stage(rest.join(merged(tried), ["a", "b"], "left_anti"))
    return tied.unionByName(_verified(_possible(rest, known, least), known, docs, text, shingle, least))
