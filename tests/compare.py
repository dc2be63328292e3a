"""Run registered queries against their SQL counterparts: ``python -m tests.compare [sf] [name part ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
ROOT = "/root/testdata"
# EXACT=1 compares the last bit of floating-point values too
EXACT = bool(os.environ.get("EXACT"))


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(arrow_type) -> str:
    text = str(arrow_type)
    for prefix, name in (("int", "int"), ("uint", "int"), ("double", "float"), ("float", "float"), ("decimal", "decimal"),
                         ("string", "str"), ("large_string", "str"), ("string_view", "str"), ("bool", "bool"), ("timestamp", "ts"), ("date", "date")):
        if text.startswith(prefix):
            return name
    return text


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if EXACT else (f"{v:.9g}" if v else "0")
    return str(v)


def rows(table) -> Counter:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return Counter(tuple(cell(v) for v in r) for r in zip(*columns))


def to_table(result):
    got = result.fetch_arrow_table() if hasattr(result, "fetch_arrow_table") else result.to_arrow_table()
    return got.read_all() if hasattr(got, "read_all") else got


def compare(spark, con, query, sql: str | None, sf_dir: str) -> tuple[str, int, float, float]:
    start = time.time()
    mine = query(spark, sf_dir).toArrow()
    took = time.time() - start
    if sql is None:
        return "rows-only", mine.num_rows, took, 0.0
    start = time.time()
    theirs = to_table(con.execute(sql))
    oracle_took = time.time() - start
    if sorted(mine.column_names) != sorted(theirs.column_names):
        return f"COLUMNS {sorted(mine.column_names)} != {sorted(theirs.column_names)}", mine.num_rows, took, oracle_took
    wrong = [
        f"{n}: {mine.schema.field(n).type} != {theirs.schema.field(n).type}"
        for n in mine.column_names
        if kind(mine.schema.field(n).type) != kind(theirs.schema.field(n).type)
    ]
    if wrong:
        return "TYPES " + "; ".join(wrong), mine.num_rows, took, oracle_took
    if mine.num_rows != theirs.num_rows:
        a, b = rows(mine), rows(theirs)
        return (f"COUNT {mine.num_rows} != {theirs.num_rows} only mine {list((a - b).items())[:2]} "
                f"only sql {list((b - a).items())[:2]}"), mine.num_rows, took, oracle_took
    a, b = rows(mine), rows(theirs)
    if a != b:
        return (f"VALUES differ in {sum((a - b).values())} rows: {list((a - b))[:2]} != {list((b - a))[:2]}",
                mine.num_rows, took, oracle_took)
    return "ok", mine.num_rows, took, oracle_took


def main() -> int:
    from genocohort.session import local_session
    import __spark_entry__ as entry

    sf_dir = f"{ROOT}/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    parts = sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            verdict, n, took, sql_took = compare(spark, con, query, sqls.get(name), sf_dir)
        except Exception as exc:  # a broken query must not hide the others
            verdict, n, took, sql_took = "ERROR " + " ".join(str(exc).split())[:700], -1, 0.0, 0.0
        good = verdict in ("ok", "rows-only") and n != 0
        bad += not good
        flag = "" if good else "!! "
        if n == 0 and verdict == "ok":
            verdict = "EMPTY"
        print(f"{flag}{name}: {verdict} rows={n} spark={took:.1f}s sql={sql_took:.1f}s", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
