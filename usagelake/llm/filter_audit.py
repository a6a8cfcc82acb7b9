"""How five filters interact: which documents each removes, alone and behind the others.

Words become a sparse document-term matrix. Blocks of documents are written as rows of a block's
own numbers for its words; the blocks' vocabularies are brought to one dictionary of the corpus,
each block's columns get the dictionary's numbers, and row sums and counts of non-zero entries of
these shards are the numbers of words and of different words.

A document then is five marks. Copies, ids and labels are folded into counts per set of marks, at
most 128 a part of the corpus, and all 120 orders of the filters are read off those counts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import give_back, read, stage
from .csr import CSR
from .registry import query

FILTERS = "ABCDE"
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK = 1 << 24
#: Blocks in a stored file, which Spark's reader and writer hold as a whole.
BLOCKS_PER_FILE = 1
_CAPITALS = bytes(range(0x41, 0x5B))
_FOLLOWING = bytes(range(0x80, 0xC0))
_SIGNS = b"#$%&*|"

_DOC = "n_points bigint, n_capitals bigint, signs boolean, text_high bigint, text_low bigint"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def matrix_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang",
                  block_bytes: int = BLOCK) -> DataFrame:
    """Stored: a row per block with its vocabulary, its matrix in compressed rows (``starts``,
    ``cols``, ``counts``) and its documents."""
    key, kind = F.col(f"`{doc_id}`"), docs.select(F.col(f"`{doc_id}`")).schema[0].dataType
    body = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    doc = T.StructType([T.StructField("doc_id", kind), T.StructField("part", T.StringType())])
    for field in T._parse_datatype_string(_DOC):
        doc.add(field)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("words", T.ArrayType(T.BinaryType())),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("cols", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("docs", T.ArrayType(doc)),
    ])
    arrow = to_arrow_schema(schema)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for row in (tuple(value.as_py() for value in values) for values in zip(*batch.columns)):
                if held and size + len(row[2]) > block_bytes:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
                    give_back()
                held.append(measure(row))
                size += len(row[2])
                if size > block_bytes:
                    yield block(number, held)
                    number, held, size = number + 1, [], 0
                    give_back()
        if held:
            yield block(number, held)
        held = None
        give_back()

    def measure(row):
        key, part, body = row
        digest = xxhash.xxh3_128_intdigest(body)
        return body, {
            "doc_id": key, "part": part, "n_points": len(body.translate(None, _FOLLOWING)),
            "n_capitals": len(body) - len(body.translate(None, _CAPITALS)),
            "signs": len(body.translate(None, _SIGNS)) != len(body),
            "text_high": _signed(digest >> 64), "text_low": _signed(digest & (1 << 64) - 1),
        }

    def block(number, held):
        known = defaultdict()
        known.default_factory = known.__len__
        columns = []
        for body, _ in held:
            words = body.split()
            columns.append(np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words)))
        col = np.concatenate(columns)
        row = np.repeat(np.arange(len(held)), [len(c) for c in columns])
        matrix = CSR.counted(row, col, len(held), len(known))
        values = [[number], [list(known)], [matrix.indptr], [matrix.indices], [matrix.data], [[d for _, d in held]]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, type=f.type) for v, f in zip(values, arrow)], schema=arrow)

    part_of = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit(""))
    return stage(docs.select(key.alias("doc_id"), part_of.alias("part"), body.alias("body"))
                 .mapInArrow(build, schema), compression="zstd", maxRecordsPerFile=BLOCKS_PER_FILE)


def numbered(blocks: DataFrame, words: bool = True) -> DataFrame:
    """Every word of every block's vocabulary: block, local (its place there), word if asked for, and
    range and within, its place in the dictionary of the corpus.

    Words are dealt over tasks by their hash, and a task numbers those it meets: its range. A word
    comes once a block, so none has more than a vocabulary's share of the rows. The numbers hold for
    what one run writes down.
    """
    entries = blocks.select("block", F.posexplode("words").alias("local", "word")).repartition("word")
    schema = "block long, local int, word binary, range int, within long"
    if not words:
        schema = schema.replace(" word binary,", "")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = defaultdict()
        known.default_factory = known.__len__
        task = TaskContext.get().partitionId()
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            different = coded.dictionary.to_pylist()
            ids = np.fromiter(map(known.__getitem__, different), dtype=np.int64, count=len(different))
            columns = {"block": batch.column("block"), "local": batch.column("local"), "word": batch.column("word"),
                       "range": pa.array(np.full(batch.num_rows, task, dtype=np.int32)),
                       "within": pa.array(ids[coded.indices.to_numpy()])}
            if not words:
                columns.pop("word")
            yield pa.RecordBatch.from_pydict(columns)

    return stage(entries.mapInArrow(number, schema), compression="zstd")


def starts(places: DataFrame) -> DataFrame:
    """The first number of each range; a row per task."""
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return places.groupBy("range").agg((F.max("within") + 1).alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def dictionary(blocks: DataFrame) -> DataFrame:
    """Every different ``word`` of the corpus with its number ``id``, from 0 without gaps."""
    places = numbered(blocks)
    return places.join(F.broadcast(starts(places)), "range").select(
        "word", (F.col("start") + F.col("within")).alias("id")).distinct()


def terms(blocks: DataFrame) -> DataFrame:
    """The dictionary's number (``id``) of every block's own number (``local``)."""
    places = numbered(blocks, words=False)
    return places.join(F.broadcast(starts(places)), "range").select(
        "block", "local", (F.col("start") + F.col("within")).alias("id"))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang",
             block_bytes: int = BLOCK) -> DataFrame:
    """Stored: one row per document with its measures: doc_id, part, n_points, n_capitals, signs,
    text_high, text_low (a 128-bit hash of the text), n_words, n_distinct.

    A null text counts as empty, a null part as the empty string. Repeated rows stay apart; an
    empty table gives an empty result; other columns are not looked at.
    """
    blocks = matrix_blocks(docs, doc_id, text, part, block_bytes)
    doc = blocks.schema["docs"].dataType.elementType
    schema = T.StructType([*doc.fields, T.StructField("n_words", T.LongType()),
                           T.StructField("n_distinct", T.LongType())])
    arrow = to_arrow_schema(schema)

    def count(block: pa.Table, numbers: pa.Table) -> pa.Table:
        starts, cols, counts = (
            np.asarray(block[name].combine_chunks()[0].values, dtype=np.int64) for name in ("starts", "cols", "counts"))
        # The dictionary's numbers as columns; a block has each of its words once.
        ids = np.empty(numbers.num_rows, dtype=np.int64)
        ids[numbers["local"].to_numpy()] = numbers["id"].to_numpy()
        shard = CSR(starts, ids[cols], counts, int(ids.max(initial=-1)) + 1)
        fields = block["docs"].combine_chunks()[0].values.flatten()
        return pa.Table.from_arrays(
            [*fields, pa.array(shard.row_sums()), pa.array(shard.row_counts())], schema=arrow)

    matrices = blocks.select("block", "starts", "cols", "counts", "docs")
    return stage(matrices.groupBy("block").cogroup(terms(blocks).groupBy("block")).applyInArrow(count, schema))


def failures(rows: DataFrame) -> DataFrame:
    """Add ``mask``: bit i is set where the document fails filter i of ABCD."""
    n, different = F.col("n_words"), F.col("n_distinct")
    fails = [
        n < 200,
        100 * different < 50 * n,
        100 * F.col("n_capitals") > 3 * F.col("n_points"),
        F.col("signs"),
    ]
    bits = [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fails)]
    return rows.withColumn("mask", sum(bits[1:], bits[0]))


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents per part, set of failed filters and labels: part, mask, good, toxic, n.

    ``labels`` has doc_id, quality and toxic; of several rows of one id any counts. A document
    fails E if a row with a smaller id has its text; rows without an id neither fail it nor make
    others fail. Copies of a text are one row per id, then one per part and labels, before they
    meet.
    """
    flags = labels.groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    text = ["text_high", "text_low", "mask"]
    once = failures(rows).groupBy(*text, "part", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    marked = once.join(flags, "doc_id", "left").fillna(False, ["good", "toxic"])
    known = F.col("doc_id").isNotNull()
    copies = marked.groupBy(*text, "part", "good", "toxic").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(~known, F.col("c"))), F.lit(0)).alias("without_id"),
        F.min(F.when(known, F.struct("doc_id", "c"))).alias("first"))
    # At most one row per part and labels, whatever the number of copies.
    texts = copies.groupBy(*text).agg(
        F.min("first.doc_id").alias("least"),
        F.collect_list(F.struct("part", "good", "toxic", "n", "without_id", "first")).alias("groups"))
    groups = texts.select("mask", "least", F.explode("groups").alias("g")).select("mask", "least", "g.*")
    stays = F.col("without_id") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    split = groups.withColumn("stays", stays).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("stays").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("stays")).alias("n")),
        )).alias("s"))
    return split.select("part", "good", "toxic", "s.*").where("n > 0").groupBy(
        "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          part: str = "lang", block_bytes: int = BLOCK) -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents of that part:
    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    A part without a removal has rows of zeros; an empty table gives an empty result.
    """
    sets = counted(measured(docs, doc_id, text, part, block_bytes), labels)
    orders = F.array(*[F.lit("".join(order)) for order in permutations(FILTERS)])
    steps = F.sequence(F.lit(1), F.lit(len(FILTERS)))
    # A few hundred rows a part, each met by the 600 steps there are.
    rows = sets.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))
    bit = {c: 1 << i for i, c in enumerate(FILTERS)}
    bits = F.create_map(*[F.lit(x) for pair in bit.items() for x in pair])
    letters = F.split("filter_order", "")
    own = F.element_at(bits, F.expr("substr(filter_order, step, 1)"))
    before = F.aggregate(
        F.slice(F.transform(letters, lambda c: F.coalesce(F.try_element_at(bits, c), F.lit(0))), F.lit(1),
                F.col("step") - 1),
        F.lit(0), lambda a, b: a.bitwiseOR(b))
    rows = rows.withColumn("own", own).withColumn("before", before)
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    earlier = F.col("mask").bitwiseAND(F.col("before")) != 0
    tests = {
        "kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier,
        "unique_fails": F.col("mask") == F.col("own"),
        "good_lost": fails & ~earlier & F.col("good"), "toxic_lost": fails & ~earlier & F.col("toxic"),
    }
    table = rows.groupBy("part", "filter_order", "step", "own").agg(
        *[F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)).alias(name) for name, t in tests.items()])
    shares = table.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return table.join(shares, ["part", "own"]).select("part", "filter_order", "step", *tests, "shapley")


@query("op13_filter_audit", sql=r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), flagged AS (
  SELECT part,
         [len(words) < 200,
          100 * len(list_distinct(words)) < 50 * len(words),
          100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body),
          regexp_matches(body, '[#$%&*|]'),
          coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS bad
  FROM docs
), sets AS (
  SELECT part, fails, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n
  FROM flagged GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step,
         strpos('ABCDE', substr(filter_order, step, 1)) AS own,
         list_transform(range(1, step), lambda i: strpos('ABCDE', substr(filter_order, i, 1))) AS before
  FROM orders, range(1, 6) AS r(step)
), met AS (
  SELECT part, filter_order, step, own, n, good, bad, fails[own] AS fails_own,
         len(list_filter(before, lambda i: fails[i])) > 0 AS gone,
         len(list_filter(fails, lambda f: f)) = 1 AND fails[own] AS alone
  FROM sets, steps
), counts AS (
  SELECT part, filter_order, step, own,
         CAST(coalesce(sum(n) FILTER (NOT fails_own AND NOT gone), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (fails_own AND NOT gone), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails_own AND gone), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n) FILTER (fails_own AND NOT gone AND good), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n) FILTER (fails_own AND NOT gone AND bad), 0) AS BIGINT) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counts
""")
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
