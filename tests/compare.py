"""Run registered queries on Spark and their SQL on DuckDB and compare the rows.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if value is None:
        return "NULL"
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    return [columns[i] for i in order], rows, types


GROUPS = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp", "FLOAT": "float", "DATE": "date",
}


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    names, got = spark_rows(df)
    took = time.time() - started
    if sql is None:
        return "rows-only", f"{sum(got.values())} rows", took
    expected_names, expected, types = duck_rows(con, sql)
    if names != expected_names:
        return "FAIL", f"columns {names} != {expected_names}", took
    notes = []
    for f in df.schema:
        want = GROUPS.get(types[f.name])
        have = f.dataType.simpleString().replace("timestamp_ntz", "timestamp")
        if want and want != have:
            notes.append(f"{f.name}: {have} vs {types[f.name]}")
        if not want:
            notes.append(f"{f.name}: {have} vs {types[f.name]}")
    if got != expected:
        left, right = list((got - expected).items())[:3], list((expected - got).items())[:3]
        return "FAIL", f"{sum(got.values())} vs {sum(expected.values())} rows {names}\n   spark {left}\n   duck  {right}", took
    if not got:
        notes.append("EMPTY RESULT")
    return "ok", f"{sum(got.values())} rows {' ; '.join(notes)}", took


def expand(argument, queries):
    """A query name, or ``@module`` for all queries of one catalog module."""
    if not argument.startswith("@"):
        return [argument]
    return [n for n, q in queries.items() if q.__module__.endswith("." + argument[1:])]


def main(argv):
    from millrace.catalog import load_all
    from millrace.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, oracle = load_all()
    names = [n for a in argv[1:] for n in expand(a, queries)] or list(queries)
    spark, con = local_session("8"), duck(sf_dir)
    failed = 0
    for name in names:
        try:
            status, note, took = compare(spark, con, sf_dir, name, queries[name], oracle.get(name))
        except Exception as error:
            status, note, took = "ERROR", "".join(traceback.format_exception_only(error))[:1500], 0.0
        failed += status in ("FAIL", "ERROR")
        print(f"{status:9} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
