"""Compares a query with its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
    conversations""".split()


def connection(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def rows(df):
    """Sorted rows with sorted columns; numbers to nine digits."""

    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return None
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v):.9g}"
        return str(v)

    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=str)


def same(spark, folder, query, sql):
    found, wanted = rows(query(spark, folder).toPandas()), rows(connection(folder).execute(sql).df())
    assert found == wanted
