"""Run registered queries against their SQL and compare rows: python -m tests.compare [dir] [name...]"""

import sys
import time

import duckdb

import __spark_entry__ as entry
from gramlode import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, con, name, sf_dir):
    """None when equal, else what differs; and the seconds of both."""
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got, got_cols = rows_of(df.columns, df.collect())
    t1 = time.time()
    res = con.execute(entry.oracle_sql()[name])
    want, want_cols = rows_of([d[0] for d in res.description], res.fetchall())
    t2 = time.time()
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    kinds = {d[0]: str(d[1]) for d in res.description}
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = {c: (t, kinds.get(c)) for c, t in types.items() if same.get(t) != kinds.get(c)}
    problem = f"types {wrong}" if wrong else None
    if got_cols != want_cols:
        problem = f"columns {got_cols} / {want_cols}"
    elif got != want:
        a, b = set(got), set(want)
        problem = f"{len(got)} / {len(want)} rows; only ours {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
    return problem, len(got), t1 - t0, t2 - t1, {c: (types[c], kinds.get(c)) for c in types}


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), database(sf)
    for q in args or list(entry.queries()):
        if q not in entry.oracle_sql():
            print(q, "rows only", entry.queries()[q](spark, sf).count(), flush=True)
            continue
        try:
            problem, n, ours, sql, types = compare(spark, con, q, sf)
            print("ok  " if problem is None else "BAD ", q, n, f"{ours:.1f}s sql {sql:.1f}s", types if args else "",
                  problem or "", flush=True)
        except Exception as e:
            print("ERR ", q, type(e).__name__, str(e)[:600], flush=True)
