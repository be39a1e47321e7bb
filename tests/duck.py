"""Comparing a DataFrame with DuckDB's answer on the same Parquet files."""

import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        path = f"{folder}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


def check(df, con, sql):
    """Equal columns and equal rows, order aside."""
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, answer.fetchall())
