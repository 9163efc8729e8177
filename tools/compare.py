"""Run registered queries on Spark and their twins on DuckDB and compare rows, columns and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from palisade.plans.queries import registered  # noqa: E402
from palisade.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    """One comparable form for values of both engines."""
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def family(name: str) -> str:
    name = name.lower()
    for prefix, kind in (("bigint", "long"), ("long", "long"), ("int64", "long"), ("integer", "int"), ("int32", "int"), ("int", "int"),
                         ("varchar", "string"), ("str", "string"), ("double", "double"), ("float64", "double"),
                         ("bool", "boolean"), ("timestamp", "timestamp"), ("datetime", "timestamp"), ("date", "date")):
        if name.startswith(prefix):
            return kind
    return name


def compare(query, spark, connection, sf_dir: str) -> tuple[bool, str]:
    frame = query.build(spark, sf_dir)
    names = sorted(frame.columns)
    rows = [tuple(plain(r[n]) for n in names) for r in frame.collect()]
    if query.oracle is None:
        return True, f"rows only: {len(rows)}"
    relation = connection.sql(query.oracle)
    if sorted(relation.columns) != names:
        return False, f"columns differ: {names} / {sorted(relation.columns)}"
    types = dict(zip(relation.columns, (family(str(t)) for t in relation.types)))
    own = {n: family(t) for n, t in frame.dtypes}
    odd = {n: (own[n], types[n]) for n in names if own[n] != types[n] and not own[n].startswith(("array", "struct", "map"))}
    position = {n: i for i, n in enumerate(relation.columns)}
    expected = [tuple(plain(r[position[n]]) for n in names) for r in relation.fetchall()]
    key = lambda r: tuple(str(v) for v in r)
    rows.sort(key=key)
    expected.sort(key=key)
    if rows != expected:
        gone = [r for r in expected if r not in set(rows)][:2]
        extra = [r for r in rows if r not in set(expected)][:2]
        return False, f"{len(rows)} rows, expected {len(expected)}; missing {gone} extra {extra} {names}"
    if odd:
        return False, f"types differ: {odd}"
    return True, f"{len(rows)} rows"


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def main() -> int:
    scale = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    chosen = sys.argv[1:]
    spark = local_session("compare")
    print()
    connection = connect(scale)
    failed = []
    for name, query in registered().items():
        if chosen and not any(c in name or c in query.build.__module__ for c in chosen):
            continue
        start = time.time()
        try:
            good, note = compare(query, spark, connection, scale)
        except Exception as error:  # report and go on with the next query
            good, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        if not good:
            failed.append(name)
        print(f"{'ok  ' if good else 'FAIL'} {name:44s} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main())
