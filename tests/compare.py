"""Run registered queries on both sides and compare rows: ``python -m tests.compare [--sf 0.01] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from wayframe.checks.registry import ORACLES, QUERIES, TABLES

ROOT = "/root/testdata"


def session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("wayframe-tests")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.6g}" if abs(v) >= 1e12 else f"{v + 0.0:.6f}".replace("-0.000000", "0.000000")
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "asDict"):
        return str([_plain(x) for x in v])
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if isinstance(v, dict):
        return str([_plain(x) for x in v.values()])
    return str(v)


def _kind(v):
    return {"int": "number", "float": "float"}.get(type(v).__name__, type(v).__name__)


def difference(spark: SparkSession, con, name: str, folder: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = QUERIES[name](spark, folder)
    ours_cols = df.columns
    ours = [dict(zip(ours_cols, r)) for r in df.collect()]
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    theirs = [dict(zip(cols, r)) for r in cur.fetchall()]
    if sorted(cols) != sorted(ours_cols):
        return f"columns {sorted(ours_cols)} against {sorted(cols)}"
    order = sorted(cols)
    for c in order:
        kinds = {_kind(r[c]) for r in ours if r[c] is not None} ^ {_kind(r[c]) for r in theirs if r[c] is not None}
        if kinds and ours and theirs:
            return f"types of {c}: {kinds}"
    a = sorted(tuple(_plain(r[c]) for c in order) for r in ours)
    b = sorted(tuple(_plain(r[c]) for c in order) for r in theirs)
    if a == b:
        return None if a else "both sides are empty"
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} rows against {len(b)}; {order}; only ours {only_a[:3]} ({len(only_a)}); only theirs {only_b[:3]} ({len(only_b)})"


def main(args: list[str]) -> int:
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    folder = f"{ROOT}/sf{sf}"
    spark, con = session(), database(folder)
    bad = 0
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) or n.endswith(a) for a in args)]
    for n in names:
        at = time.time()
        try:
            if n in ORACLES:
                why = difference(spark, con, n, folder)
            else:
                rows = QUERIES[n](spark, folder).count()
                why = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:700]}"
        bad += why is not None
        mark = "ok  " if why is None else "FAIL"
        print(f"{mark} {n} {time.time() - at:.1f}s {'' if n in ORACLES else '(rows only)'} {why or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    import wayframe.checks.all  # noqa: F401
    sys.exit(main(sys.argv[1:]))
