"""Runs queries on Spark and their SQL on DuckDB and compares the results.

    python -m tests.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return "NULL" if v is None else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


def difference(df, con, sql: str) -> str | None:
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    want_cols, want = rows([c[0] for c in rel.description], rel.fetchall())
    types = {c[0]: str(c[1]) for c in rel.description}
    numeric = {"HUGEINT": "sum needs a cast", "INT128": "cast"}
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if any(t in numeric for t in types.values()):
        return f"types {types}"
    if not want:
        return "no rows"
    if got != want:
        extra = [r for r in got if r not in set(want)][:3]
        missing = [r for r in want if r not in set(got)][:3]
        return f"{len(got)} rows != {len(want)}; only Spark {extra}; only SQL {missing}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from waymark.plans.registry import load_all
    from waymark.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = 0
    for name, q in load_all().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if q.sql:
                problem = difference(q.run(spark, sf_dir), con, q.sql)
            else:
                problem = None if q.run(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if q.sql else '(no sql) '}{problem or ''}"[:2500], flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
