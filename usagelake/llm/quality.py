"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model predicts each character from the four before it. Counts of 5-grams come from all trusted
documents that are not kept for calibration; every lower order counts in how many different ways
its n-grams were continued to the left. Three discounts per order are taken from the counts of
counts, and what they free is given to the next lower order.

The finished tables are cut into shards by the last two characters of the context, so that all
orders which a position asks for beyond the second lie in one shard. Documents are scored against
one shard at a time, each of bounded size, and the partial sums of a document are added up.

A document is kept if its perplexity is no higher than a quantile of the calibration documents in
its language.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import read, stage
from .registry import query

ORDER = 5
#: Bits of a character: code points below 2,048 as they are, others folded into as many classes.
BITS = 12
CLASSES = 1 << BITS
#: Rows of the tables in a shard, besides those of the two lowest orders: 16 bytes each.
SHARD_ROWS = 1 << 21
#: Characters handled at once in a task.
CHUNK = 1 << 22
#: Trusted ids are broadcast up to so many, 16 bytes each; beyond that they are joined by shuffle.
BROADCAST_IDS = 1 << 21
#: One in so many trusted documents sets the thresholds and is not learned from.
CALIBRATE = 5
#: Documents of the calibration set above its threshold.
QUANTILE = 0.99


def classes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of all texts, each text behind ORDER - 1 zeros, and the texts' starts.

    Letters are lower-cased, and white space of any length and kind is one blank.
    """
    lead = "\0" * (ORDER - 1)
    joined = "".join([lead + " ".join((t or "").replace("\0", " ").lower().split()) for t in texts])
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype="<u4")
    chars = np.where(code < 2048, code, 2048 + code % 2047).astype(np.uint64)
    lengths = np.fromiter(map(len, joined.split(lead)[1:]), dtype=np.int64, count=len(texts))
    first = np.cumsum(lengths + ORDER - 1) - lengths - (ORDER - 1)
    return chars, first


def grams_of(chars: np.ndarray) -> np.ndarray:
    """The 5-gram that ends at each place from the fifth on, as one number."""
    out = np.zeros(max(0, len(chars) - ORDER + 1), dtype=np.uint64)
    for i in range(ORDER):
        out = out << np.uint64(BITS) | chars[i:len(chars) - ORDER + 1 + i]
    return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about CHUNK characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in _chunks(texts):
            chars, _ = classes_of(texts[a:b])
            grams = grams_of(chars)[chars[ORDER - 1:] > 0]
            gram, n = np.unique(grams, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], names=["gram", "n"])


def train(trusted: DataFrame, text: str = "text") -> DataFrame:
    """The stored model: (table, code, value).

    Table 2 k has the discounted shares of n-grams of k characters, table 2 k - 1 what is left to
    the next lower order after the contexts of such n-grams.
    """
    some = trusted.select(F.col(f"`{text}`").cast("string"))
    counts = stage(some.mapInArrow(_count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    tables = []
    for size in range(ORDER, 0, -1):
        if size < ORDER:
            counts = stage(counts.groupBy(F.col("gram").bitwiseAND((1 << BITS * size) - 1).alias("gram")).agg(
                F.count(F.lit(1)).alias("n")))
        row = counts.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5)]).first()
        cut = discounts(list(row))
        grouped = counts.withColumn("context", F.shiftright("gram", BITS)).withColumn(
            "cut", F.element_at(F.array(*map(F.lit, cut)), F.least("n", F.lit(3)).cast("int")))
        total = grouped.groupBy("context").agg(F.sum("n").alias("all"), F.sum("cut").alias("freed"))
        share = grouped.join(total, "context").select(
            F.lit(2 * size).alias("table"), F.col("gram").alias("code"),
            ((F.col("n") - F.col("cut")) / F.col("all")).cast("float").alias("value"))
        rest = total.select(F.lit(2 * size - 1).alias("table"), F.col("context").alias("code"),
                            (F.col("freed") / F.col("all")).cast("float").alias("value"))
        tables += [share, rest]
    model = tables[0]
    for table in tables[1:]:
        model = model.unionByName(table)
    return stage(model)


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Discounts of n-grams seen once, twice, and more often. Each is at least 0.1 and stays below
    the count, also where a small corpus leaves a count of counts at zero."""
    n1, n2, n3, n4 = (max(1, n) for n in counts_of_counts)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]


class Shard:
    """Tables for the positions whose last two context characters fall into the shard.

    On its way to the tasks a shard is packed: codes in order as steps, then compressed. Tasks
    index it when they first use it.
    """

    def __init__(self, rows: pa.Table, number: int, shards: int):
        self.number, self.shards = number, shards
        table, code = rows.column("table").to_numpy(), rows.column("code").to_numpy().view(np.uint64)
        order = np.lexsort((code, table))
        self.code, self.value = code[order], rows.column("value").to_numpy()[order]
        self.ends = np.searchsorted(table[order], np.arange(2 * ORDER + 2))
        self.tables: list[tuple[np.ndarray, np.ndarray]] | None = None

    def __getstate__(self):
        steps = np.diff(self.code, prepend=np.uint64(0))
        return (self.number, self.shards, self.ends, zlib.compress(steps.tobytes(), 1),
                zlib.compress(self.value.astype("<f4").tobytes(), 1))

    def __setstate__(self, state):
        self.number, self.shards, self.ends, steps, values = state
        self.code = np.cumsum(np.frombuffer(zlib.decompress(steps), dtype=np.uint64), dtype=np.uint64)
        self.value = np.frombuffer(zlib.decompress(values), dtype="<f4")
        self.tables = None

    def _index(self) -> None:
        """A hash table of the log-probabilities of all 5-grams seen; where two collide one stays."""
        self.tables = [(self.code[a:b], self.value[a:b]) for a, b in zip(self.ends, self.ends[1:])]
        seen, _ = self.tables[2 * ORDER]
        self.bits = max(8, int(4 * len(seen)).bit_length())
        self.slots = np.full(1 << self.bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.logs = np.zeros(1 << self.bits, dtype=np.float32)
        at = self._slot(seen)
        self.slots[at] = seen
        self.logs[at] = self._slow(seen)

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (gram * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _look(self, table: int, code: np.ndarray, missing: float) -> np.ndarray:
        codes, values = self.tables[table]
        if not len(codes):
            return np.full(len(code), missing)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        return np.where(codes[at] == code, values[at], missing)

    def _slow(self, gram: np.ndarray) -> np.ndarray:
        p = np.full(len(gram), 1.0 / CLASSES)
        for size in range(1, ORDER + 1):
            code = gram & np.uint64((1 << BITS * size) - 1)
            rest = self._look(2 * size - 1, code >> np.uint64(BITS), 1.0)
            p = self._look(2 * size, code, 0.0) + rest * p
        return np.log(p)

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self._index()
        at = self._slot(gram)
        out = self.logs[at].astype(np.float64)
        miss = np.flatnonzero(self.slots[at] != gram)
        if len(miss):
            different, back = np.unique(gram[miss], return_inverse=True)
            out[miss] = self._slow(different)[back]
        return out

    def mine(self, gram: np.ndarray) -> np.ndarray | None:
        """Which positions the shard scores; None for all."""
        if self.shards == 1:
            return None
        return _shard_of((gram >> np.uint64(BITS)) & np.uint64((1 << 2 * BITS) - 1), self.shards) == self.number


def _shard_of(pair: np.ndarray, shards: int) -> np.ndarray:
    return (pair * np.uint64(2654435761) >> np.uint64(8)) % np.uint64(shards)


def shards_of(model: DataFrame) -> Iterator[Shard]:
    """The shards of a stored model, one after the other; as many as its rows ask for."""
    shards = max(1, -(-model.where("table > 4").count() // SHARD_ROWS))
    context = F.when(F.col("table") % 2 == 0, F.shiftright("code", BITS)).otherwise(F.col("code"))
    pair = context.bitwiseAND((1 << 2 * BITS) - 1)
    number = F.shiftright(pair * 2654435761, 8) % shards
    for i in range(shards):
        yield Shard(model.where((F.col("table") <= 4) | (number == i)).toArrow(), i, shards)


def _score(docs: DataFrame, shard: Shard) -> DataFrame:
    """Stored: (doc_id, body_hash, lang, n, log_p) per document: what the shard's positions add."""
    spread = docs.sparkSession.sparkContext.broadcast(shard)
    schema = T.StructType([
        *[docs.schema[c] for c in ("doc_id", "body_hash", "lang")],
        T.StructField("n", T.LongType()), T.StructField("log_p", T.DoubleType()),
    ])
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spread.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            for a, b in _chunks(texts):
                chars, first = classes_of(texts[a:b])
                grams = grams_of(chars)
                used = chars[ORDER - 1:] > 0
                mine = table.mine(grams)
                used = used if mine is None else used & mine
                values = np.zeros(len(chars) + 1)
                values[ORDER - 1:-1][used] = table.log_p(grams[used])
                count = np.zeros(len(chars) + 1, dtype=np.int64)
                count[ORDER - 1:-1] = used
                head = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    *[head.column(i) for i in range(3)], pa.array(np.add.reduceat(count, first)),
                    pa.array(np.add.reduceat(values, first)),
                ], schema=arrow)

    scored = stage(docs.mapInArrow(score, schema))
    spread.destroy()  # what it gave is stored
    return scored


def perplexity(docs: DataFrame, model: DataFrame, doc_id: str = "doc_id", text: str = "text",
               lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, lang, n (characters scored) and perplexity, null where n is 0."""
    body = F.col(f"`{text}`").cast("string")
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(body).alias("body_hash"),
                         F.col(f"`{lang}`").cast("string").alias("lang"), body.alias("text"))
    parts = [_score(narrow, shard) for shard in shards_of(model)]
    if len(parts) == 1:
        rows = parts[0]
    else:
        # Equal rows have equal sums, so they are added together and set apart again.
        union = parts[0].withColumn("part", F.lit(0))
        for i, part in enumerate(parts[1:], 1):
            union = union.unionByName(part.withColumn("part", F.lit(i)))
        rows = union.groupBy(F.struct("doc_id", "body_hash", "lang").alias("key")).agg(
            F.sum("n").alias("n"), F.sum("log_p").alias("log_p"),
            F.count(F.when(F.col("part") == 0, 1)).cast("int").alias("copies"),
        ).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("key.*", "n", "log_p", "copies")
        rows = rows.withColumn("n", (F.col("n") / F.col("copies")).cast("long")).withColumn(
            "log_p", F.col("log_p") / F.col("copies"))
    return rows.select("doc_id", "lang", "n", F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n"))).alias("perplexity"))


def classify(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, n, perplexity, threshold, kept.

    ``trusted`` has the ids of trusted documents in its first column; a fifth of them, by checksum
    of the id, set the thresholds, and the others train the model. A language without calibration
    documents, null included, has the threshold of all of them together; without any at all
    everything with text is kept. A text without characters has no perplexity and is not kept. Rows
    that repeat an id or text are scored one by one; an empty table gives an empty result.
    """
    ids = stage(trusted.select(F.col(f"`{trusted.columns[0]}`").alias("_trusted")).where("_trusted IS NOT NULL").distinct())
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    learned = F.crc32(F.col("_trusted").cast("string").cast("binary")) % CALIBRATE != 0
    key = F.col(f"`{doc_id}`")
    model = train(docs.join(few.where(learned), key == F.col("_trusted"), "left_semi"), text)
    scored = stage(perplexity(docs, model, doc_id, text, lang))
    known = scored.join(few.where(~learned), F.col("doc_id") == F.col("_trusted"), "left_semi").where("n > 0")
    level = F.percentile_approx("perplexity", quantile, 10000)
    by_lang = known.where("lang IS NOT NULL").groupBy("lang").agg(level.alias("own"))
    overall = known.agg(level).first()[0]
    return (
        scored.join(by_lang, "lang", "left")
        .withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
        .select("doc_id", "lang", "n", "perplexity", "threshold",
                ((F.col("n") > 0) & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))).alias("kept"))
    )


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id")
    return classify(read(spark, sf_dir, "documents"), trusted)
