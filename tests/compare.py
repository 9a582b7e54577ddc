"""Run registered queries next to their SQL in DuckDB.

usage: python tests/compare.py [name-prefix ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return ("f", "nan") if math.isnan(v) else ("f", repr(v + 0.0))
    return (type(v).__name__, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, sf, fn, sql):
    """None if equal, else a short description."""
    df = fn(spark, sf)
    got, gn = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want, wn = rows_of([d[0] for d in cur.description], cur.fetchall())
    if gn != wn:
        return f"columns {gn} vs {wn}"
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {bad[:2]}" if bad else None


def main(prefixes):
    import __spark_entry__ as e
    from voxeval.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles, failed = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            if name in oracles:
                msg = compare(spark, con, sf, fn, oracles[name])
            else:
                rows = fn(spark, sf).collect()
                msg = None if rows else "no rows"
                for r in rows[:12]:
                    print("    ", r)
        except Exception as ex:  # report and go on
            msg = f"{type(ex).__name__}: {str(ex)[:700]}"
        print(f"{'ok ' if msg is None else 'BAD'} {name} {time.time() - t:.1f}s {'' if name in oracles else '(no sql) '}{msg or ''}", flush=True)
        if msg:
            failed.append(name)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
