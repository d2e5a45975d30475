"""Compare catalogue queries with their DuckDB SQL on one set of tables. Also runs as a script:

    python tests/oracle_check.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def order(row):
    return tuple((v is None, str(v)) for v in row)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted((tuple(canonical(v) for v in row) for row in df.select(*columns).collect()), key=order)
    spent = time.time() - start
    if name not in entry.oracle_sql():
        return len(mine) > 0, f"{spent:6.2f}s rows={len(mine)} (rows only)"
    start = time.time()
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    if sorted(names) != columns:
        return False, f"columns {columns} vs {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(canonical(row[i]) for i in at) for row in result.fetchall()), key=order)
    note = f"{spent:6.2f}s duckdb {time.time() - start:6.2f}s rows={len(mine)}"
    if len(mine) != len(theirs):
        return False, f"{note} vs {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if wrong:
        return False, f"{note} {len(wrong)} differ, first:\n   {str(wrong[0][0])[:600]}\n   {str(wrong[0][1])[:600]}"
    return True, note


if __name__ == "__main__":
    from newsloom.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    bad = []
    for name in sys.argv[2:] or list(entry.queries()):
        try:
            ok, note = compare(spark, con, name, sys.argv[1])
        except Exception as failure:  # noqa: BLE001
            ok, note = False, f"{type(failure).__name__}: {str(failure)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        bad += [] if ok else [name]
    print("failed:", bad)
    spark.stop()
