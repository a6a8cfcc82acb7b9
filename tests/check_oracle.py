"""Run registered questions against their reference SQL.

    python tests/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(type(x)), x) for x in row)


def _clean(x):
    if isinstance(x, float):
        return float(f"{x:.6f}") + 0.0
    return x


KINDS = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "INTEGER": "int", "BOOLEAN": "boolean"}


def compare(spark, con, name, query, sql, sf_dir):
    """``(ok, message, seconds)`` for one question."""
    start = time.time()
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(_clean(x) for x in r) for r in df.select(*columns).collect()), key=_key)
    took = time.time() - start
    kinds = dict(df.dtypes)
    if not sql:
        return True, f"rows={len(got)} (no SQL)", took
    rel = con.sql(sql)
    want_columns = sorted(rel.columns)
    if want_columns != columns:
        return False, f"columns {columns} vs {want_columns}", took
    types = dict(zip(rel.columns, (str(t) for t in rel.types)))
    odd = {c: (kinds[c], types[c]) for c in columns if KINDS.get(types[c]) != kinds[c]}
    order = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(_clean(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    if odd:
        return False, f"types differ {odd}", took
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return False, f"rows {len(got)} vs {len(want)}\n  got  {extra}\n  want {missing}", took
    return True, f"rows={len(got)}", took


def main() -> int:
    from usagelake import build_session
    from workload import questions

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(questions.QUERIES)
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, message, took = compare(
                spark, con, name, questions.QUERIES[name], questions.SQL.get(name), sf_dir
            )
        except Exception as error:
            ok, message, took = False, f"{type(error).__name__}: {str(error)[:1200]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {message if not ok or 'no SQL' in message else message}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
