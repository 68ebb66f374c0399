"""Compares a query with its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(r[i] for i in order)) for r in rows)


def check(spark, folder, query, sql):
    df = query(spark, folder)
    found = connect(folder).execute(sql)
    want = rows_of([d[0] for d in found.description], found.fetchall())
    assert rows_of(df.columns, df.collect()) == want
