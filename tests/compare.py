"""Run registered queries in Spark and their SQL in DuckDB, and compare rows.

python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb
import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (np.generic,)):
        return plain(value.item())
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    return value


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark, con, sf, name, fn, sql) -> str | None:
    """None when equal, else what differs."""
    mine = fn(spark, sf)
    left = rows([tuple(r) for r in mine.collect()], mine.columns)
    if sql is None:
        return None if left else "no rows"
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    right = rows(cur.fetchall(), columns)
    if sorted(columns) != sorted(mine.columns):
        return f"columns {sorted(mine.columns)} != {sorted(columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}: {[r for r in left if r not in set(right)][:2]} {[r for r in right if r not in set(left)][:2]}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} != {b}"
    return None if left else "no rows"


def main(argv):
    from runledger.session import local_session
    from runledger.workloads import ORACLES, QUERIES

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name in names:
        begin = time.time()
        try:
            why = difference(spark, con, sf, name, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # report and go on
            why = f"{type(error).__name__}: {str(error)[:600]}"
        mark = "ok  " if why is None else "FAIL"
        print(f"{mark} {time.time() - begin:6.2f}s {name}{'' if name in ORACLES else ' (rows only)'} {why or ''}", flush=True)
        if why:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} equal; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
