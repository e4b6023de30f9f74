"""Compares a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings sources news_items raw_items item_metrics news_events merge_verdicts taxonomy_nodes stories source_targets context_windows".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "as_tuple"):
        return round(float(v), 9)
    return v


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    table = df.select(*names).toArrow().to_pydict()
    return names, Counter(tuple(plain(x) for x in r) for r in zip(*(table[n] for n in names)))


def rows_of_sql(c, sql: str) -> tuple[list[str], Counter]:
    out = c.sql(sql)
    order = sorted(range(len(out.columns)), key=lambda i: out.columns[i])
    return [out.columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in out.fetchall())


def compare(df, c, sql: str) -> str:
    names, mine = rows_of(df)
    want_names, want = rows_of_sql(c, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if mine != want:
        return f"{sum(mine.values())} rows, want {sum(want.values())}; extra {list((mine - want).items())[:3]}; missing {list((want - mine).items())[:3]}"
    return ""
