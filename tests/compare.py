"""Run a query and its SQL side by side, as the driver does."""

import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(_plain(r[i])) for i in order) for r in rows)


def compare(df, con, sql):
    """(spark rows, sql rows, first differences)."""
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = _rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    if got == expected:
        return len(got), len(expected), []
    extra, missing = sorted(set(got) - set(expected)), sorted(set(expected) - set(got))
    return len(got), len(expected), [("spark", extra[:2]), ("sql", missing[:2])]
