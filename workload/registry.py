"""Registry of runnable questions and the reference SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; its result is flattened to plain column types."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return flat(fn(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


def flat(df: DataFrame) -> DataFrame:
    """Dates and lists as text, whole numbers as BIGINT, real ones to six places."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind == "date":
            col = col.cast("string")
        elif kind in ("int", "smallint", "tinyint", "boolean"):
            col = col.cast("bigint")
        elif re.match(r"decimal\(\d+,0\)", kind):
            col = col.cast("bigint")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            col = F.round(col.cast("double"), 6)
        elif kind == "array<string>":
            col = F.array_join(col, "|")
        elif kind.startswith(("array", "struct", "map")):
            col = F.to_json(col)
        elif kind.startswith("timestamp"):
            col = F.unix_millis(col)
        out.append(col.alias(name))
    return df.select(*out)
