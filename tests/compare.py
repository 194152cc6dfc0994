"""Run catalog queries next to their SQL counterparts and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def difference(spark_df, con, sql: str) -> str:
    """'' when the results are equal, else a short description."""
    names = spark_df.columns
    left = _rows(names, spark_df.collect())
    cursor = con.execute(sql)
    other = [d[0] for d in cursor.description]
    if sorted(names) != sorted(other):
        return f"columns {sorted(names)} != {sorted(other)}"
    right = _rows(other, cursor.fetchall())
    if left == right:
        return ""
    extra = [r for r in left if r not in set(right)][:2] if len(left) < 200_000 else []
    missing = [r for r in right if r not in set(left)][:2] if len(right) < 200_000 else []
    return f"rows {len(left)} / {len(right)}; only spark {extra}; only sql {missing}"


def main(argv) -> None:
    import __spark_entry__ as entry
    from jobsieve.session import local_session

    sf_dir = argv[1]
    wanted = argv[2:]
    spark = local_session()
    queries, oracle = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            result = difference(fn(spark, sf_dir), con, oracle[name]) if name in oracle else "no sql"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {str(error)[:600]}"
        print(f"{name:24s} {time.time() - started:6.1f}s {result or 'ok'}", flush=True)
    print("without query:", sorted(set(oracle) - set(queries)))


if __name__ == "__main__":
    sys.path.insert(0, ".")
    main(sys.argv)
