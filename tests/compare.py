"""Comparison of a query's rows with its SQL, as the columns' names and values go."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return canonical(con.sql(sql).df())


def canonical(frame):
    """Sorted tuples of the values, columns by name; whole floats of null-bearing columns print as whole numbers."""
    frame = frame[sorted(frame.columns)]
    show = lambda v: "null" if pd.isna(v) else (repr(int(v)) if isinstance(v, float) and v.is_integer() else str(v))
    return list(frame.columns), sorted(tuple(show(v) for v in row) for row in frame.astype(object).itertuples(index=False))
