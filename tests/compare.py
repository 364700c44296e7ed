"""Run registered queries against their DuckDB counterparts, by sorted rows."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value in a form both engines share."""
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def table(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, type(v).__name__, v if v is not None else 0) for v in r))


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    left = table(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    right = table(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; e.g. {left[:2]} / {right[:2]}"
    for a, b in zip(left, right):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(names)}: {a} != {b}"
    return None


def main(sf_dir: str, only: list[str]) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from tests.conftest import make_session

    spark, con = make_session(), duck(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    print("without SQL:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
    bad = 0
    for name, query in queries.items():
        if only and name not in only:
            continue
        began = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, query, sql[name], sf_dir)
            else:
                problem = f"(rows only: {query(spark, sf_dir).count()})"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem) and not problem.startswith("(")
        print(f"{name:32s} {time.time() - began:6.2f}s  {problem or 'ok'}"[:900], flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
