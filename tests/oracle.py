"""Run registered queries next to their SQL and compare names, counts and values.

Command line: ``python -m tests.oracle SF_DIR [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if value is None:
        return ("none", "")
    if isinstance(value, bool):
        return ("bool", str(value))
    if isinstance(value, float):
        return ("num", "nan" if math.isnan(value) else repr(value + 0.0))
    if isinstance(value, int):
        return ("num", str(value))
    if isinstance(value, (bytes, bytearray)):
        return ("bytes", bytes(value).hex())
    return (type(value).__name__, str(value))


def compare(spark, con, sf, run, sql):
    """None if equal, else a short account of the difference."""
    got = run(spark, sf).toArrow()
    want = con.execute(sql).fetchall()
    names = [c[0] for c in con.description]
    if sorted(got.column_names) != sorted(names):
        return f"columns {sorted(got.column_names)} != {sorted(names)}"
    if got.num_rows != len(want):
        return f"rows {got.num_rows} != {len(want)}"
    columns = sorted(names)
    place = [names.index(c) for c in columns]
    table = got.select(columns).to_pydict()
    left = sorted(tuple(map(_plain, row)) for row in zip(*[table[c] for c in columns]))
    right = sorted(tuple(_plain(row[i]) for i in place) for row in want)
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(bad)} rows differ, first {bad[0]}"
    if not left:
        return "no rows"
    return None


def main() -> int:
    from spanwell.plans import QUERIES, SQL
    from spanwell.session import local_session

    sf, chosen = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session("8"), connect(sf)
    failed = 0
    for name in chosen:
        began = time.time()
        try:
            if name in SQL:
                note = compare(spark, con, sf, QUERIES[name], SQL[name])
            else:
                note = None if QUERIES[name](spark, sf).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            note = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += note is not None
        kind = "sql" if name in SQL else "rows"
        print(f"{name:28s} {kind:4s} {time.time() - began:6.1f}s {note or 'ok'}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main())
