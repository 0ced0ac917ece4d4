"""Compare a Spark result with the same query in DuckDB, value by value."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float) or type(v).__name__.startswith("float"):
        v = float(v)
        return None if math.isnan(v) else ("f", repr(v + 0.0))
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return ("b", bool(v))
    if isinstance(v, int) or type(v).__name__.startswith(("int", "uint")):
        return ("i", int(v))
    return (type(v).__name__, str(v))


def rows_of(records, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark_df, sql: str, con) -> str | None:
    """None when equal, else a description of the difference."""
    names = spark_df.columns
    left = rows_of([tuple(r) for r in spark_df.collect()], names)
    cur = con.execute(sql)
    other = [d[0] for d in cur.description]
    right = rows_of(cur.fetchall(), other)
    if sorted(names) != sorted(other):
        return f"columns differ: {sorted(names)} / {sorted(other)}"
    if len(left) != len(right):
        return f"row counts differ: {len(left)} / {len(right)}; e.g. {left[:2]} / {right[:2]}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        cols = sorted(names)
        diff = [(c, x, y) for c, x, y in zip(cols, a, b) if x != y]
        return f"{len(bad)} of {len(left)} rows differ, first: {diff} in {a}"
    return None


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from seqatlas.session import local_session

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = local_session()
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not wanted or any(n.startswith(w) for w in wanted)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                problem = compare(df, oracle[name], con)
                count = None
            else:
                problem, count = None, df.count()
        except Exception as e:
            problem, count = f"{type(e).__name__}: {str(e)[:900]}", None
        took = time.time() - start
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] if problem is None else ""
        notes = [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "InPandas", "ArrowEvalPython") if w in plan]
        notes.append(f"exchanges {plan.count('Exchange ')}")
        verdict = "ok" if problem is None else "FAIL"
        failed += problem is not None
        print(f"{verdict:5} {name:28} {took:6.2f}s {'' if count is None else f'rows only: {count}'} {problem or ''} {notes}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")


if __name__ == "__main__":
    main(sys.argv[1:])
