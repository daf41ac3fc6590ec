"""Run named queries on Spark and their SQL on DuckDB, and compare whole results.

    python tests/oracle.py [--sf /root/testdata/sf0.01] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return float(f"{value:.10g}")
    if isinstance(value, int):
        return float(value)
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.10g}")
    return str(value)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(df, con, sql: str) -> str:
    """Empty text when both results hold the same rows, otherwise what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    theirs = rel.fetchall()
    cols = df.columns
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} != {sorted(names)}"
    order = [cols.index(n) for n in names]
    ours = Counter(tuple(norm(r[i]) for i in order) for r in df.collect())
    want = Counter(tuple(norm(v) for v in r) for r in theirs)
    if ours == want:
        return ""
    only_ours, only_theirs = ours - want, want - ours
    return (f"rows {sum(ours.values())} vs {sum(want.values())}; only ours {sum(only_ours.values())} "
            f"{names} {list(only_ours)[:3]}; only sql {list(only_theirs)[:3]}")


def main(argv):
    import __spark_entry__ as e
    from priorview.session import build_session

    sf = "/root/testdata/sf0.001"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                          "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                          "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, os_ = e.queries(), e.oracle_sql()
    bad = 0
    for name in argv or qs:
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            if name in os_:
                diff = compare(df, con, os_[name])
            else:
                diff = "" if df.count() > 0 else "no rows"
        except Exception as exc:  # report and go on with the next query
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += bool(diff)
        print(f"{'ok  ' if not diff else 'FAIL'} {name} {time.time() - t0:.1f}s {'' if name in os_ else '(rows only) '}{diff}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
