"""Run registered queries next to their SQL and compare whole results.

``python tests/compare.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
TESTDATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(v):
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, float) and not math.isnan(v):
            return repr(v + 0.0) if v else "0.0"
        return repr(v)

    return sorted("|".join(text(r[i]) for i in order) for r in rows)


def kinds(types) -> list[str]:
    """Coarse column kinds, comparable between the engines."""
    names = {
        "bigint": "int", "int": "int", "INTEGER": "int", "BIGINT": "int", "HUGEINT": "huge", "double": "float",
        "DOUBLE": "float", "string": "text", "VARCHAR": "text", "boolean": "bool", "BOOLEAN": "bool",
    }
    return [names.get(str(t), str(t)) for t in types]


def compare(spark, con, name, query, sql, sf_dir) -> str:
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows-only {len(got)}"
    rel = con.sql(sql)
    expected = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"COLUMNS {df.columns} vs {rel.columns}"
    mine = dict(zip(df.columns, kinds(f.dataType.simpleString() for f in df.schema.fields)))
    theirs = dict(zip(rel.columns, kinds(rel.types)))
    if mine != theirs:
        return f"TYPES { {c: (mine[c], theirs[c]) for c in mine if mine[c] != theirs[c]} }"
    a, b = canonical(df.columns, got), canonical(list(rel.columns), expected)
    if a == b:
        return f"ok {len(a)}"
    left, right = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"DIFF rows {len(a)} vs {len(b)}; mine {left[:3]} theirs {right[:3]} ({len(left)})"


def main() -> None:
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark, con = make_session(), duck(sf_dir)
    for name in wanted:
        start = time.time()
        try:
            result = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:24s} {time.time() - start:6.2f}s  {result}", flush=True)


if __name__ == "__main__":
    main()
