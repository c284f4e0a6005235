"""Rows of DuckDB SQL over a folder of tables, and comparison with Spark rows."""

import datetime
import os
from pathlib import Path

import duckdb

TESTDATA = os.environ.get("GRANARY_TESTDATA", "/root/testdata/sf0.001")


def connection(folder: str = TESTDATA):
    con = duckdb.connect()
    for p in Path(folder).iterdir():
        if p.suffix == ".parquet":
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int | float):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def compare(spark, query, sql, folder: str = TESTDATA):
    df = query(spark, folder)
    names = sorted(df.columns)
    want = connection(folder).sql(sql)
    assert sorted(want.columns) == names
    got = ordered(df.select(*names).collect())
    expected = ordered(want.select(*names).fetchall())
    assert len(got) == len(expected)
    assert got == expected
    return got
