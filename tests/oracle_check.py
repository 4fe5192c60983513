"""Run registered queries against their SQL: ``python tests/oracle_check.py [sf] [name…]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(v)


def compare(df, con, sql: str) -> str:
    """Empty when names, types and rows agree, else what differs."""
    names = sorted(df.columns)
    types = {d[0]: str(d[1]) for d in con.execute(f"SELECT * FROM ({sql}) AS r LIMIT 0").description}
    if sorted(types) != names:
        return f"columns {names} here, {sorted(types)} in SQL"
    for field in df.schema:
        want = SPARK_TO_SQL.get(field.dataType.simpleString(), field.dataType.simpleString())
        if types[field.name] != want:
            return f"type of {field.name}: {want} here, {types[field.name]} in SQL"
    rows = con.execute(f"SELECT {', '.join(names)} FROM ({sql}) AS r").fetchall()
    theirs = sorted(tuple(map(_cell, r)) for r in rows)
    ours = sorted(tuple(map(_cell, (r[n] for n in names))) for r in df.collect())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows here, {len(theirs)} in SQL; {ours[:3]} {theirs[:3]}"
    differing = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(differing)} of {len(ours)} rows differ: {names} {differing[:3]}" if differing else ""


def main(argv) -> int:
    from tabscale.plans import catalogue
    from tabscale.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0].startswith("/"):
        sf_dir, argv = argv[0], argv[1:]
    names = [n for n in catalogue.QUERIES if not argv or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in argv)]
    spark = local_session(8)
    con = connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = catalogue.QUERIES[name](spark, sf_dir)
            if name in catalogue.ORACLES:
                problem = compare(df, con, catalogue.ORACLES[name])
                status = "ok" if not problem else f"DIFF {problem}"
            else:
                rows = df.collect()
                problem = "" if rows else "no rows"
                status = f"rows {len(rows)}" if rows else "DIFF no rows"
        except Exception as error:  # report every query, not the first failure only
            problem = status = f"ERROR {type(error).__name__} {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s {status}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
