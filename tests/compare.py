"""python tests/compare.py SF_DIR [NAME...]: queries against their SQL twins in DuckDB."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows(df, *cols):
    """All rows, or the named columns of them, in a fixed order."""
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


def canonical(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(canonical(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((canonical(k), canonical(x)) for k, x in v.items()))
    return v


def compare(spark, con, fn, sql: str, sf_dir: str) -> str:
    """An empty string where both give the same bag of rows, else what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(canonical(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(canonical(r[i]) for i in at) for r in cur.fetchall())
    if got == want:
        return "" if want else "both are empty"
    return f"rows {sum(got.values())} and {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    return con


def main() -> None:
    import __spark_entry__ as entry
    from locusframe.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "10g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            if name in sqls:
                said = compare(spark, con, fn, sqls[name], sf_dir) or "ok"
            else:
                said = f"no SQL; rows {fn(spark, sf_dir).count()}"
        except Exception as e:  # noqa: BLE001
            said = "ERROR " + str(e)[:700]
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
