"""Compare a query with its SQL as the driver does: columns by name, rows in any order."""

import glob
import math
import os


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def same(df, con, sql):
    got = con.execute(sql)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([d[0] for d in got.description], got.fetchall())
