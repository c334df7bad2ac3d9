"""Side-by-side runs of a query and its SQL."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def rows_of_sql(sql: str, sf_dir: str, **tables: str):
    """tables: other Parquet files or globs in place of those of sf_dir."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tables.get(t, f'{sf_dir}/{t}.parquet')}'")
    found = con.sql(sql)
    cols = sorted(found.columns)
    at = [found.columns.index(c) for c in cols]
    return cols, sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
