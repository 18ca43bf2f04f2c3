"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

import glob
import os

import duckdb


def database(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def same_rows(spark, sf_dir, query, sql):
    df, found = query(spark, sf_dir), database(sf_dir).sql(sql)
    names = sorted(df.columns)
    assert sorted(found.columns) == names
    theirs = [tuple(r[found.columns.index(c)] for c in names) for r in found.fetchall()]
    ours = [tuple(r[c] for c in names) for r in df.collect()]
    assert _sorted(ours) == _sorted(theirs)
    return len(ours)
