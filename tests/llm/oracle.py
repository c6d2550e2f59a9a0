"""The driver's comparison in small: rows of a query against its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)


def rows_of_df(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
