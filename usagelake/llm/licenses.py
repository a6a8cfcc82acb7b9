"""License scans by diagonal voting.

Rolling hashes of k words of every document are joined to the places of the same k words in license
templates. A passage copied from a template gives matches at a constant distance between document
and template place, its diagonal: matches are counted per diagonal, diagonals that lie close
together are merged (words added or left out shift it), and a merged span counts as the license if
enough of the template and of the span itself are matched.

Short phrases are templates too, of two-word hashes; one occurs exactly where a diagonal has all of
them, and its place is the diagonal itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import read, stage
from .registry import query
from .words import words_of

# Phrases that name a license, and the label of each.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Notices that licenses ask to be placed in the files they cover.
NOTICES = (
    ("agpl", "it under the terms of the gnu affero general public license as published by the free "
             "software foundation"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a "
               "copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 "
                 "international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted provided that the above copyright notice"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free "
             "software foundation"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
#: Words in a hash, for phrases and for notices.
PHRASE_K, NOTICE_K = 2, 4
#: Diagonals of a notice this close, with no more words than this between, are one span.
NEIGHBOUR = 8
#: Shares of the notice's hashes and of the span's that must match.
LEAST_NOTICE, LEAST_SPAN = 0.5, 0.5


class Templates:
    """Words of all templates as numbers from 1, and the rolling hashes of both kinds.

    A hash is the number whose digits, to the base of one more than the words there are, are the
    words; so different word sequences never have the same hash.
    """

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        self.terms: dict[bytes, int] = {}
        self.rows: list[tuple[int, int, int, str, int]] = []
        texts = [(label, text, PHRASE_K) for label, text in phrases]
        texts += [(label, text, NOTICE_K) for label, text in notices]
        numbered = [
            (label, k, [self.terms.setdefault(w, len(self.terms) + 1) for w in words_of(text.encode())])
            for label, text, k in texts
        ]
        self.base = len(self.terms) + 1
        if self.base ** NOTICE_K >= 1 << 62:
            raise ValueError("the templates have too many different words for exact hashes")
        for number, (label, k, words) in enumerate(numbered):
            for at, gram in enumerate(self.hashes(np.array(words, dtype=np.int64), k)[1].tolist()):
                self.rows.append((number, k, gram, label, at))
        self.sizes = [(number, label, k, len(words) - k + 1) for number, (label, k, words) in enumerate(numbered)]

    def hashes(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all runs of k words that templates know (number 0: unknown)."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        known = np.ones(n, dtype=bool)
        code = np.zeros(n, dtype=np.int64)
        for i in range(k):
            part = words[i:i + n]
            known &= part > 0
            code = code * self.base + part
        at = np.flatnonzero(known)
        return at, code[at]


def scan_grams(docs: DataFrame, templates: Templates, doc_id: str, text: str) -> DataFrame:
    """Stored: a row per document with its rolling hashes, those with a word that no template has
    left out, as they equal none."""
    body, key = F.encode(F.col(f"`{text}`").cast("string"), "UTF-8"), F.col(f"`{doc_id}`")
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("doc_id", docs.select(key).schema[0].dataType),
        T.StructField("n_words", T.LongType()), T.StructField("k", T.ArrayType(T.IntegerType())),
        T.StructField("at", T.ArrayType(T.LongType())), T.StructField("gram", T.ArrayType(T.LongType())),
    ])
    arrow = to_arrow_schema(schema)
    spread = docs.sparkSession.sparkContext.broadcast(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spread.value
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            n, found = [], ([], [], [])
            for body in batch.column(1):
                words = words_of(body.as_py())
                numbers = np.fromiter(map(known.terms.get, words, repeat(0)), dtype=np.int64, count=len(words))
                parts = [(k, *known.hashes(numbers, k)) for k in (PHRASE_K, NOTICE_K)]
                n.append(len(words))
                found[0].append(np.concatenate([np.full(len(at), k, dtype=np.int32) for k, at, _ in parts]))
                found[1].append(np.concatenate([at for _, at, _ in parts]))
                found[2].append(np.concatenate([gram for _, _, gram in parts]))
            lists = [pa.array(column, type=arrow.field(i).type) for i, column in enumerate(found, 3)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n, pa.int64()), *lists],
                schema=arrow)
            row += len(n)

    return stage(docs.select(key.alias("doc_id"), body.alias("body")).mapInArrow(scan, schema))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases=PHRASES,
                  notices=NOTICES) -> DataFrame:
    """One row per document: doc_id, n_words, places and spans.

    places: (label, first) of every place of a phrase, by first word; spans: (label, first, last,
    share of the notice matched) of every verified notice. Words count from 0. A null text counts
    as empty; repeated rows are scanned one by one; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    templates = Templates(phrases, notices)
    rows = scan_grams(docs, templates, doc_id, text)
    # As large as the templates given, some hundred rows here; the planner broadcasts what is small.
    at_template = spark.createDataFrame(
        templates.rows, "template int, k int, gram long, label string, template_at long")
    sizes = spark.createDataFrame(templates.sizes, "template int, label string, k int, grams long")
    grams = rows.select("row", F.explode(F.arrays_zip("k", "at", "gram")).alias("g")).select("row", "g.*")
    votes = (
        grams.join(at_template, ["k", "gram"])
        .groupBy("row", "template", (F.col("at") - F.col("template_at")).alias("diagonal"))
        .agg(F.count(F.lit(1)).alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
        .join(sizes, "template")
    )
    phrase = F.col("k") == PHRASE_K
    places = votes.where(phrase & (F.col("votes") == F.col("grams"))).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(F.col("diagonal").alias("first"), "label"))).alias("places"))
    # Diagonals that follow each other closely are a band, whatever else lies between them in the
    # text; in a band, matches without a long gap are a span.
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    by_place = Window.partitionBy("row", "template", "band").orderBy("first", "diagonal")
    so_far = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    away = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > NEIGHBOUR
    apart = F.col("first") > so_far + NEIGHBOUR
    merged = (
        votes.where(~phrase).withColumn("away", F.coalesce(away, F.lit(True)).cast("int"))
        .withColumn("band", F.sum("away").over(by_diagonal))
        .withColumn("starts", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("span", F.concat_ws(":", "band", F.sum("starts").over(by_place)))
        .groupBy("row", "template", "span", "label", "k", "grams")
        .agg(F.sum("votes").alias("votes"), F.min("first").alias("first"), F.max("last").alias("last"))
        .withColumn("share", F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
        .where((F.col("share") >= LEAST_NOTICE)
               & (F.col("votes") >= LEAST_SPAN * (F.col("last") - F.col("first") + 1)))
    )
    spans = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
        "first", (F.col("last") + F.col("k") - 1).alias("last"), "label", "share"))).alias("spans"))
    none = {"places": "array<struct<first:bigint,label:string>>",
            "spans": "array<struct<first:bigint,last:bigint,label:string,share:double>>"}
    return (
        rows.select("row", "doc_id", "n_words").join(places, "row", "left").join(spans, "row", "left")
        .select("doc_id", "n_words",
                *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()])
    )


@query("op4_licenses")
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is 1 where a phrase names a license, else the best share of a notice."""
    found = scan_licenses(read(spark, sf_dir, "documents"))
    first = F.transform("places", lambda p: p["first"])
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    noticed = F.transform("spans", lambda s: s["label"])
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, noticed)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )
