"""Run registered queries next to their SQL and report differences."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("null",)
    if isinstance(value, float):
        return ("float", repr(value + 0.0))
    return (type(value).__name__, repr(value))


def differences(df, con, sql: str) -> str | None:
    """None when columns and rows agree, else a short description."""
    columns = sorted(df.columns)
    mine = sorted(tuple(_cell(row[c]) for c in columns) for row in df.collect())
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    if sorted(names) != columns:
        return f"columns {columns} != {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = sorted(tuple(_cell(row[i]) for i in at) for row in relation.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} rows != {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(mine)} rows differ, first {wrong[0]}"[:1500]
    return None


def main(sf_dir: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.session import session

    spark = session()
    con = connect(sf_dir)
    failed = 0
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                result = differences(df, con, sqls[name])
            else:
                rows = df.count()
                result = None if rows else "no rows"
                name += f" (rows only: {rows})"
        except Exception as error:  # noqa: BLE001
            result = f"error {type(error).__name__}: {str(error)[:1200]}"
        took = time.time() - start
        failed += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {took:6.1f}s {name} {result or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
