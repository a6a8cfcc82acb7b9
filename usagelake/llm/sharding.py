"""Sharding: a k-d tree over document metadata, cut at distributed weighted medians.

A node that is to become k shards is cut along its widest dimension where k // 2 of its k equal
parts of the bytes lie on the left. The cut is found digit by digit: one aggregation gives the
bytes per digit of 12 bits, the digit in which the wanted weight falls is opened, and the next
aggregation looks only inside it. Each aggregation serves all nodes of a level and brings at most
4,096 sums per node to the driver; the tree itself is a nested CASE expression over the metadata.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_bits, read, running_total, stage
from .registry import query

DIGIT = 12
#: Bits of a sort key: the dimension, then the hash of the text, then that of the row.
KEY_BITS, TEXT_FROM = 60, 24
#: A cut that falls into a group of equal texts moves to the group's edge if that shifts no more
#: than this share of a shard.
EDGE = 0.02
#: Bytes counted for a document beside its text.
EXTRA = 8


class _Node:
    """A part of the tree: a leaf while ``cut`` is None. Shards are numbered from ``first``."""

    def __init__(self, first: int, shards: int):
        self.first, self.shards = first, shards
        self.dim = self.cut = self.left = self.right = None

    def split(self, dim: int, cut: int) -> list[_Node]:
        n = self.shards // 2
        self.dim, self.cut = dim, cut
        self.left, self.right = _Node(self.first, n), _Node(self.first + n, self.shards - n)
        return [self.left, self.right]

    def column(self) -> Column:
        if self.cut is None:
            return F.lit(self.first)
        key = _key(self.dim)
        return F.when(key < F.lit(self.cut), self.left.column()).otherwise(self.right.column())


def _key(dim: int) -> Column:
    return F.shiftleft(F.col(f"d{dim}").cast("long"), KEY_BITS - DIGIT).bitwiseOR(F.col("tie"))


def _scaled(column: Column) -> Column:
    """A category as a coordinate of 12 bits."""
    return hash_bits(column, bits=DIGIT).cast("int")


def metadata(docs: DataFrame, doc_id: str, text: str, dims: list[str]) -> DataFrame:
    """doc_id, size, text_crc32, row hash, tie and one 12-bit coordinate per dimension.

    Dimension 0 is the size on a logarithmic scale, 128 steps per doubling; the others are the
    named columns, whose values are dealt over the scale by hash, nulls as a value of their own.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    size = (F.octet_length(body) + F.lit(EXTRA)).cast("long")
    key = F.col(f"`{doc_id}`")
    tie = F.shiftleft(hash_bits(body, bits=24), TEXT_FROM).bitwiseOR(hash_bits(key, bits=24))
    log = F.least(F.lit((1 << DIGIT) - 1), F.floor(F.log2(size.cast("double")) * 128)).cast("int")
    return docs.select(
        key.alias("doc_id"), size.alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        hash_bits(body, key).alias("order"), tie.alias("tie"), log.alias("d0"),
        *[_scaled(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(dims, 1)],
    )


def _of_node(nodes: list[_Node], values: dict[_Node, object]) -> Column:
    """The value of each row's node; rows of other nodes get null."""
    pairs = [x for n in nodes for x in (F.lit(n.first), F.lit(values[n]))]
    return F.element_at(F.create_map(*pairs), F.col("node"))


def _cuts(placed: DataFrame, nodes: list[_Node], dims: dict[_Node, int], total: dict[_Node, int],
          edge: float) -> dict[_Node, int]:
    """The sort key of every node at which its left part ends."""
    want = {n: total[n] * (n.shards // 2) / n.shards for n in nodes}
    prefix, before = {n: 0 for n in nodes}, {n: 0 for n in nodes}
    done: dict[_Node, int] = {}
    key = F.coalesce(*[F.when(_of_node(nodes, dims) == d, _key(d)) for d in sorted(set(dims.values()))])
    keyed = placed.withColumn("key", key)
    for low in range(KEY_BITS - DIGIT, -1, -DIGIT):
        live = [n for n in nodes if n not in done]
        if not live:
            break
        inside = keyed.where(F.col("node").isin([n.first for n in live])).where(
            F.shiftright("key", low + DIGIT) == _of_node(live, prefix)
        )
        sums = defaultdict(list)
        for row in (
            inside.groupBy("node", F.shiftright("key", low).bitwiseAND((1 << DIGIT) - 1).alias("digit"))
            .agg(F.sum("size").alias("size")).collect()
        ):
            sums[row["node"]].append((row["digit"], row["size"]))
        for n in live:
            found = sorted(sums[n.first])
            digit, weight = (found or [(0, 0)])[0]
            for digit, weight in found:
                if before[n] + weight >= want[n]:
                    break
                before[n] += weight
            else:
                before[n] -= weight
            prefix[n] = (prefix[n] << DIGIT) | digit
            short = want[n] - before[n] <= before[n] + weight - want[n]
            near = prefix[n] if short else prefix[n] + 1
            off = min(abs(want[n] - before[n]), abs(before[n] + weight - want[n]))
            if low == 0 or (low == TEXT_FROM and off <= edge * total[n] / n.shards):
                done[n] = near << low
    return done


def kd_shards(
    docs: DataFrame, shards: int | None = 24, target_bytes: int | None = None,
    doc_id: str = "doc_id", text: str = "text", dims: tuple = ("lang", "source"), edge: float = EDGE,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    Give the number of shards, or ``target_bytes`` and as many are made as hold the total. Shards
    hold near equal bytes: each cut is exact to one document, or to ``edge`` of a shard where
    that keeps a group of equal texts together; a larger group is cut, as no one shard could hold
    it. Slots count from 0 in each shard without gaps, in an order that depends on ids and texts
    alone. A null text counts as empty; null ids and dimensions are values of their own; rows that
    repeat id and text fall side by side, whole sets of them into one shard. Shards that no
    document reaches stay empty, as do all in an empty table.
    """
    rows = stage(metadata(docs, doc_id, text, list(dims)))
    width = range(len(dims) + 1)
    if target_bytes is not None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    root = _Node(0, shards)
    level = [root]
    while level := [n for n in level if n.shards > 1]:
        placed = rows.withColumn("node", root.column())
        ends = {r["node"]: r for r in placed.groupBy("node").agg(
            F.sum("size").alias("size"),
            *[(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"w{i}") for i in width],
        ).collect()}
        total = {n: ends[n.first]["size"] if n.first in ends else 0 for n in level}
        dims_of = {
            n: max(width, key=lambda i, n=n: ends[n.first][f"w{i}"]) if n.first in ends else 0
            for n in level
        }
        cuts = _cuts(placed, level, dims_of, total, edge)
        level = [child for n in level for child in n.split(dims_of[n], cuts[n])]
    placed = rows.select("doc_id", "size", "text_crc32", "order", root.column().alias("shard"),
                         F.lit(1).alias("one"))
    return running_total(placed, ["shard"], "order", "one", "slot").drop("order", "one").select(
        "doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
