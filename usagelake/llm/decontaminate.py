"""Benchmark decontamination with a positional inverted index.

The documents of a task are laid end to end into segments of about ``SEGMENT`` words, with a gap
after each document that no match can bridge. The stored index has a row per segment and term: the ascending places of the
term in the segment, as steps of 32 bits. A test window, so many consecutive words of a benchmark
item, occurs where the lists of its terms meet once each is moved back by the term's offset; lists
are intersected from the rarest term on, so most windows end after one look.

Only terms of the benchmark are stored, as no other list is ever asked for. A segment's lists are
searched together, so one task holds one segment, however common a word or a passage is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import keep_rows, read, stage
from .registry import query
from .words import words_of

#: Words of a test window; an item of fewer words is one window.
WINDOW = 10
#: Words of a segment; it ends with the document that reaches this.
SEGMENT = 1 << 20
#: A proximity match has every term of a window within so many words of its place.
SLOP = 3
#: Words of the benchmark searched for at once. A larger benchmark is searched in blocks of its
#: items of about this size, each block against the whole index.
TEST_WORDS = 1 << 21

class Tests:
    """Windows of some benchmark items, with their terms as numbers from 1."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            words = [self.terms.setdefault(w, len(self.terms) + 1) for w in words_of(text)]
            width = min(window, len(words))
            for start in range(len(words) - width + 1 if width else 0):
                self.windows[tuple(words[start:start + width])].add(item)

    def rarest_first(self, frequency: dict[int, int]) -> list[tuple[tuple[int, ...], list[int], list[str]]]:
        """Windows whose terms all occur: terms, offsets from the rarest term on, items."""
        return [
            (terms, sorted(range(len(terms)), key=lambda k: (frequency[terms[k]], k)), sorted(items))
            for terms, items in self.windows.items() if all(t in frequency for t in terms)
        ]


def _index_schema(doc_id: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("segment", T.LongType()), T.StructField("term", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("steps", T.BinaryType()),
        T.StructField("doc_id", doc_id), T.StructField("body_hash", T.LongType()),
        T.StructField("first", T.LongType()),
    ])


def build_index(docs: DataFrame, terms: dict[bytes, int], gap: int, doc_id: str, text: str) -> DataFrame:
    """Stored rows of two kinds: a document (term 0, n words from place ``first``) or a term's list."""
    body, key = F.col(f"`{text}`"), F.col(f"`{doc_id}`")
    schema = _index_schema(docs.select(key).schema[0].dataType)
    arrow = to_arrow_schema(schema)
    spread = docs.sparkSession.sparkContext.broadcast(terms)

    def rows_of(number: int, heads: list[pa.RecordBatch], words: list[int], parts: list[np.ndarray]):
        """The index rows of one segment: its documents, then its lists."""
        n = np.array(words, dtype=np.int64)
        table = pa.Table.from_batches(heads)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(n), number)), pa.array(np.zeros(len(n), dtype=np.int32)), pa.array(n),
            pa.nulls(len(n), pa.binary()), table.column(0).combine_chunks(), table.column(1).combine_chunks(),
            pa.array(np.cumsum(n + gap) - n - gap),
        ], schema=arrow)
        place = np.concatenate(parts)
        used = np.flatnonzero(place)
        order = used[np.argsort(place[used], kind="stable")]
        term, start, count = np.unique(place[order], return_index=True, return_counts=True)
        steps = [np.diff(order[s:s + k], prepend=0).astype("<i4").tobytes() for s, k in zip(start, count)]
        none = len(term)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(none, number)), pa.array(term.astype(np.int32)), pa.array(count.astype(np.int64)),
            pa.array(steps, pa.binary()), pa.nulls(none, arrow.field("doc_id").type), pa.nulls(none, pa.int64()),
            pa.nulls(none, pa.int64()),
        ], schema=arrow)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, space = spread.value, np.zeros(gap, dtype=np.int32)
        number = TaskContext.get().partitionId() << 32
        heads, words, parts, size = [], [], [], 0
        for batch in batches:
            begun = 0
            for i, text in enumerate(batch.column(2)):
                found = words_of(text.as_py())
                words.append(len(found))
                parts += [np.fromiter(map(known.get, found, repeat(0)), dtype=np.int32, count=len(found)), space]
                size += len(found) + gap
                if size >= SEGMENT:
                    heads.append(batch.slice(begun, i + 1 - begun))
                    yield from rows_of(number, heads, words, parts)
                    number, begun, heads, words, parts, size = number + 1, i + 1, [], [], [], 0
            if begun < batch.num_rows:
                heads.append(batch.slice(begun))
        if words:
            yield from rows_of(number, heads, words, parts)

    narrow = docs.select(key, F.xxhash64(body), F.encode(body.cast("string"), "UTF-8"))
    return stage(narrow.toDF("doc_id", "body_hash", "body").mapInArrow(segments, schema))


def _places(windows: list, slop: int, lists: dict[int, np.ndarray], size: int):
    """Places (first, width, items, exact) of windows in a segment."""
    place = np.zeros(size + 64, dtype=np.int32)
    for term, at in lists.items():
        place[at] = term
    for terms, offsets, items in windows:
        if not all(t in lists for t in terms):
            continue
        base = lists[terms[offsets[0]]] - offsets[0]
        base = base[base >= 0]
        found = base
        for k in offsets[1:]:
            if not len(found):
                break
            found = found[place[np.minimum(found + k, size)] == terms[k]]
        for first in found.tolist():
            yield first, len(terms), items, True
        near = np.setdiff1d(base, found, assume_unique=True)
        for k in offsets[1:]:
            if not len(near):
                break
            at = lists[terms[k]]
            after = np.minimum(np.searchsorted(at, near + k - slop), len(at) - 1)
            near = near[np.abs(at[after] - near - k) <= slop]
        for first in near.tolist():
            yield first, len(terms), items, False


def _searcher(windows, slop: int):
    """A function from the index rows of one segment to the matches in its documents."""

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        heads = rows[rows["term"] == 0].sort_values("first")
        start = heads["first"].to_numpy(dtype=np.int64)
        long = heads["n"].to_numpy(dtype=np.int64)
        size = int(start[-1] + long[-1] + 1) if len(heads) else 0
        lists = {
            t: np.cumsum(np.frombuffer(s, dtype="<i4"), dtype=np.int64)
            for t, s in rows.loc[rows["term"] > 0, ["term", "steps"]].itertuples(index=False, name=None)
        }
        exact, near, spans = defaultdict(set), defaultdict(set), defaultdict(list)
        for at, width, names, whole in _places(windows.value, slop, lists, size):
            doc = int(np.searchsorted(start, at, side="right") - 1)
            if at + width > start[doc] + long[doc]:
                continue  # a proximity match that reaches beyond its document
            if whole:
                exact[doc].update(names)
                spans[doc].append((at - int(start[doc]), at - int(start[doc]) + width - 1))
            else:
                near[doc].update(names)
        out = []
        for doc in sorted({*exact, *near}):
            merged: list[list[int]] = []
            for first, last in sorted(spans[doc]):
                if merged and first <= merged[-1][1] + 1:
                    merged[-1][1] = max(merged[-1][1], last)
                else:
                    merged.append([first, last])
            out.append((int(heads["segment"].iloc[0]), int(start[doc]), sorted(exact[doc]), sorted(near[doc]),
                        [{"first": a, "last": b} for a, b in merged]))
        return pd.DataFrame(out, columns=["segment", "first", "items", "near", "spans"])

    return search


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per document with the benchmark passages in it.

    doc_id, body_hash, n_words, n_hit (words inside an exact match), items (ids of exact matches,
    as sorted strings), near_items (ids of proximity matches only), spans (first and last word of
    the stretches that exact matches cover, from 0). A match does not cross documents. Null texts
    have no words; a null item id is the empty string; equal item ids count once, and repeated
    documents are searched one by one. An empty benchmark matches nothing, and an empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    body = F.encode(F.col(f"`{item_text}`").cast("string"), "UTF-8")
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), body.alias("body")
    )
    words = items.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = max(1, -(-words // (6 * TEST_WORDS)))
    block_of = F.pmod(F.xxhash64("item", "body"), F.lit(blocks))
    hit_kind = "segment long, first long, items array<string>, near array<string>, spans array<struct<first:long,last:long>>"
    results = []
    for block in range(blocks):
        tests = Tests([(r["item"], r["body"]) for r in items.where(block_of == block).collect()], window)
        index = build_index(docs, tests.terms, slop + 1, doc_id, text)
        frequency = dict(index.where("term > 0").groupBy("term").agg(F.sum("n")).toPandas().itertuples(index=False))
        spread = spark.sparkContext.broadcast(tests.rarest_first(frequency))

        lists = index.select("segment", "term", "n", "steps", "first")
        found = lists.groupBy("segment").applyInPandas(_searcher(spread, slop), hit_kind)
        heads = index.where("term = 0").select("segment", "first", "doc_id", "body_hash", F.col("n").alias("n_words"))
        results.append(heads.join(found, ["segment", "first"], "left"))
    none = F.array().cast("array<string>")
    if blocks == 1:
        rows = results[0].select(
            "doc_id", "body_hash", "n_words", F.coalesce("items", none).alias("items"),
            F.coalesce("near", none).alias("near"),
            F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("spans"),
        )
    else:
        rows = _together([r.withColumn("block", F.lit(i)) for i, r in enumerate(results)])
    covered = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(-1).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda done, s: F.struct(
            F.greatest(done["end"], s["last"]).alias("end"),
            (done["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(s["first"] - 1, done["end"]))).alias("n"),
        ),
    )["n"]
    return rows.select(
        "doc_id", "body_hash", "n_words", covered.alias("n_hit"), F.array_sort("items").alias("items"),
        F.array_sort(F.array_except("near", "items")).alias("near_items"), F.array_sort("spans").alias("spans"),
    )


def _together(blocks: list[DataFrame]) -> DataFrame:
    """One row per document from the rows of each block of the benchmark.

    Every block's index numbers the same documents alike, unless the input was read in another
    order; equal documents have equal matches, so rows are told apart by id, text and rank.
    """
    rows = blocks[0]
    for more in blocks[1:]:
        rows = rows.unionByName(more)
    key = F.struct("doc_id", "body_hash")
    merged = rows.groupBy(key.alias("key"), "n_words").agg(
        F.count(F.when(F.col("block") == 0, 1)).alias("copies"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_set("near"))).alias("near"),
        F.flatten(F.collect_set("spans")).alias("spans"),
    )
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "key.doc_id", "key.body_hash", "n_words", "items", "near", "spans")


def without_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``docs`` without an exact match, repeated ones too, with all their columns."""
    found = find(docs, benchmark, doc_id, text)
    return keep_rows(docs, found.where("n_hit = 0"), doc_id, text)


@query("op6_decontaminate", sql=r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
widths AS (SELECT item_id, w, least(10, len(w)) AS width FROM items WHERE len(w) > 0),
tests AS (
  SELECT DISTINCT item_id, width, array_to_string(w[i:i + width - 1], ' ') AS phrase
  FROM (SELECT *, unnest(generate_series(1, len(w) - width + 1)) AS i FROM widths)),
places AS (
  SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, width, unnest(generate_series(1, len(w) - width + 1)) AS i
        FROM words, (SELECT DISTINCT width FROM tests) WHERE len(w) >= width)),
matches AS (SELECT p.doc_id, t.item_id, p.i, p.width FROM places p JOIN tests t USING (width, phrase)),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit
         FROM (SELECT doc_id, unnest(generate_series(i, i + width - 1)) AS place FROM matches) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM matches) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
