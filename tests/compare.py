"""Compare a query's rows with its SQL's rows, order aside."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 9) + 0.0
    return value


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(shaped, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    mine_names, mine = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs_names, theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if mine_names != theirs_names:
        return f"columns {mine_names} vs {theirs_names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{a} vs {b}"
    return None
