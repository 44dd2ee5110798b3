"""Oracle check: run a registered Spark query and its DuckDB SQL on the same
parquet tables and compare row count, column names and values (order
insensitive, floats to a relative tolerance).

    python -m tidemark.plans.check /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duckdb_con(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, (int, decimal.Decimal)):
        return (2, float(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (3, "nan")
        return (2, v)
    if isinstance(v, dt.datetime):
        return (4, v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return (5, v.isoformat())
    return (6, str(v))


def _close(a, b) -> bool:
    if a[0] != b[0]:
        return False
    if a[0] == 2:
        x, y = a[1], b[1]
        return x == y or abs(x - y) <= 1e-9 * max(1.0, abs(x), abs(y))
    return a == b


def compare(spark_rows: list[tuple], spark_cols: list[str], duck_rows: list[tuple],
            duck_cols: list[str]) -> str | None:
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: spark={sorted(spark_cols)} duck={sorted(duck_cols)}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    s = sorted(tuple(_norm(r[i]) for i in si) for r in spark_rows)
    d = sorted(tuple(_norm(r[i]) for i in di) for r in duck_rows)
    if len(s) != len(d):
        return f"row count spark={len(s)} duck={len(d)}"
    for a, b in zip(s, d):
        if not all(_close(x, y) for x, y in zip(a, b)):
            diff = [(order[i], x, y) for i, (x, y) in enumerate(zip(a, b)) if not _close(x, y)]
            return f"value mismatch {diff[:4]}"
    return None


def check(spark, sf_dir: str, names: list[str] | None = None, verbose: bool = True) -> dict:
    from tidemark.plans.catalog import oracle_sql, queries
    qs, sqls = queries(), oracle_sql()
    con = duckdb_con(sf_dir)
    out = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
            t1 = time.time()
            if name not in sqls:
                out[name] = ("rows-only", len(rows))
            else:
                res = con.execute(sqls[name])
                dcols = [d[0] for d in res.description]
                drows = res.fetchall()
                err = compare(rows, cols, drows, dcols)
                out[name] = ("OK", len(rows)) if err is None else ("FAIL", err)
        except Exception as e:  # noqa: BLE001
            t1 = time.time()
            out[name] = ("ERROR", f"{type(e).__name__}: {str(e)[:400]}")
        if verbose:
            print(f"{name:32s} {out[name][0]:9s} {str(out[name][1])[:300]}  ({t1 - t0:.1f}s)",
                  flush=True)
    return out


if __name__ == "__main__":
    from tidemark.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    sp = get_session("local[8]", shuffle_partitions=8)
    res = check(sp, sf, names)
    bad = {k: v for k, v in res.items() if v[0] in ("FAIL", "ERROR")}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
    sys.exit(1 if bad else 0)
