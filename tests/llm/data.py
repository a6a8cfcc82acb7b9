"""Small documents with the cases every operator must stand: null, empty, long, tied and repeated."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = {"row": 1, "size": 2, "key": "k", "fp": 3, "n": 4, "node": 5, "shard": 6, "start": 7, "words": "w",
         "line": 8, "set_id": 9, "lang_pred": "x", "component_id": 10, "k": 11, "position": 0.5}


def plain(n: int = 60, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = {
        "en": "the of and to in is that was with for house river stone winter morning letter garden".split(),
        "de": "der die und das ist nicht mit ein auf für haus fluss stein winter morgen brief garten".split(),
        "fr": "le la et les des est une pour dans que maison rivière pierre hiver matin lettre jardin".split(),
    }
    rows = []
    for i in range(n):
        lang = ("en", "de", "fr")[i % 3]
        words = [rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 120))]
        lines = [" ".join(words[j:j + 17]) for j in range(0, len(words), 17)]
        text = "\n".join(lines)
        rows.append((i, text, lang, f"src{i % 4}", len(text)))
    return rows


def odd(first: int = 1000) -> list[tuple]:
    """Null in every column, no words, white space, signs only, very long, copies, repeated rows."""
    base = plain(3, seed=9)
    long = " ".join(random.Random(3).choices("the river ran over the stone and the garden slept".split(), k=120_000))
    return [
        (None, "a text without an id that is long enough to matter for anything here", "en", "src1", 5),
        (None, None, None, None, None),
        (first, None, "en", "src0", None),
        (first + 1, "", "de", None, 0),
        (first + 2, " \t\n\r ", None, "src0", 5),
        (first + 3, "?!. --- ...", "en", "src9", 11),
        (first + 4, long, "en", "src0", len(long)),
        (first + 5, base[0][1], "en", "src0", 1), (first + 6, base[0][1], "de", "src1", 1),
        (first + 7, base[1][1], "de", "src2", 2), (first + 7, base[1][1], "de", "src2", 2),
        (first + 8, "Ünï¢ödé 日本語 текст \U0001F600 word", None, "src2", 9),
    ]


def frame(spark, rows=None, clash: bool = False):
    df = spark.createDataFrame(plain() + odd() if rows is None else rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit(value) for name, value in CLASH.items()})
    return df


def texts(rows=None) -> list[tuple]:
    return [(r[0], r[1]) for r in (plain() + odd() if rows is None else rows)]
