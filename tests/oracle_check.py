"""Compare registered queries with their SQL oracles, row for row and type for type.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from cellpath.session import local_session  # noqa: E402

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    """Empty text when equal, else what differs; and the number of rows."""
    df = contract.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    types = dict(df.dtypes)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    cur = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    oracle_types = {d[0]: str(d[1]) for d in cur.description}
    rows = cur.fetchall()
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}", len(rows)
    order = [names.index(c) for c in columns]
    want = Counter(tuple(r[i] for i in order) for r in rows)
    wrong = {c: (types[c], oracle_types[c]) for c in columns if SPARK_TO_DUCK.get(types[c], types[c]) != oracle_types[c]}
    if wrong:
        return f"types {wrong}", len(rows)
    if got != want:
        return f"rows {sum(got.values())} vs {sum(want.values())}; only spark {list((got - want).items())[:3]}; only sql {list((want - got).items())[:3]}", len(rows)
    return "", len(rows)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in sys.argv[2:] or contract.queries():
        start = time.time()
        try:
            problem, rows = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", 0
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} rows={rows:7d} {time.time() - start:6.1f}s {problem}", flush=True)
    print(f"{failed} failed")
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
