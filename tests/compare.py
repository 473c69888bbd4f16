"""Row comparison of a registered query with its SQL text in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, bytearray):
        return bytes(value)
    return value


def rows(columns: list[str], data) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return [columns[n] for n in order], Counter(tuple(plain(row[n]) for n in order) for row in data)


def differences(df, con: duckdb.DuckDBPyConnection, text: str) -> str | None:
    """None for equal results, else what differs."""
    relation = con.execute(text)
    names, kinds = [d[0] for d in relation.description], [str(d[1]) for d in relation.description]
    want_names, want = rows(names, relation.fetchall())
    got_names, got = rows(df.columns, df.collect())
    if got_names != want_names:
        return f"columns {got_names} instead of {want_names}"
    simple = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    simple |= {"timestamp_ntz": "TIMESTAMP"}
    types = {c: simple.get(t, t) for c, t in df.dtypes}
    # An all-null column has no type of its own in the check.
    other = {c: (types[c], k) for c, k in zip(names, kinds) if types[c] != k and k not in ("NULL",)}
    if other:
        return f"types {other}"
    if got != want:
        return (
            f"{got.total()} rows instead of {want.total()}; extra {list((got - want).items())[:3]}, "
            f"missing {list((want - got).items())[:3]}"
        )
    return None if want else "no rows"


if __name__ == "__main__":
    import sys
    import time

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from opsframe.plans import registry
    from opsframe.plans.session import local_session

    only = sys.argv[2:]
    for path in sorted(glob.glob(os.path.join(os.path.dirname(registry.__file__), "queries_*.py"))):
        __import__(f"opsframe.plans.{os.path.basename(path)[:-3]}")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    for name, run in registry.QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            if name in registry.ORACLES:
                verdict = differences(run(spark, sys.argv[1]), con, registry.ORACLES[name]) or "ok"
            else:
                verdict = f"rows only: {run(spark, sys.argv[1]).count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__} {str(error)[:600]}"
        print(f"{time.time() - start:6.1f}s {name}: {verdict}", flush=True)
