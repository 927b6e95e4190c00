"""Runs queries in Spark and their SQL in DuckDB and compares the rows."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(frame):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA:
            return None
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        try:
            return round(float(x), 6)
        except (TypeError, ValueError):
            return str(x)

    columns = sorted(frame.columns)
    return columns, sorted(([cell(x) for x in row] for row in frame[columns].itertuples(index=False)), key=repr)


def difference(spark_df, con, sql):
    """None if equal, else what differs."""
    a, b = canonical(spark_df.toPandas()), canonical(con.sql(sql).df())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows: {a[1][:3]} {b[1][:3]}"
    return next((f"{x} and {y}" for x, y in zip(a[1], b[1]) if x != y), None)
