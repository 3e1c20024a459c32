"""Run a query and its SQL check on the same tables and compare the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def compare(df, con, sql):
    """Rows found and, where the two sides differ, a short account of it."""
    cur = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cur.description}
    want_cols, want = rows_of(list(types), cur.fetchall())
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    n = sum(got.values())
    if want_cols != got_cols:
        return n, f"columns {got_cols} != {want_cols}"
    odd = [(c, t, types[c]) for c, t in df.dtypes if TYPES.get(t) != types[c]]
    if odd:
        return n, f"types {odd}"
    if want == got:
        return n, "" if n else "no rows on either side"
    extra, missing = got - want, want - got
    return n, (
        f"rows {n} vs {sum(want.values())}; "
        f"extra {list(extra.items())[:2]}; missing {list(missing.items())[:2]}"
    )
