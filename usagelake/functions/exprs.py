"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space, "word edge" and word characters as ECMAScript defines them. Java's \b treats
# accented letters as word characters and its \s misses the Unicode spaces.
SPACE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NON_SPACE = r"[^\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    A column referenced twice is planned twice; binding it to a lambda variable keeps long
    chains of regular expressions linear instead of exponential.
    """
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim with the ECMAScript notion of white space."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def js_round(value: Column) -> Column:
    """Half-up towards positive infinity; Spark's ``round`` sends -2.5 to -3."""
    return F.floor(value + F.lit(0.5))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit the contract's character counts are stated in."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def string_array(values) -> Column:
    """Array literal of strings; one call to the JVM however long the list, folded when planned."""
    joined = "\x1f".join(values)
    return F.split(F.lit(joined), "\x1f")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated exactly once per row.

    Adjacent projections are merged by the optimizer, which would repeat an expensive expression
    for every later use, lambdas included. A one-element generator keeps it in place.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
