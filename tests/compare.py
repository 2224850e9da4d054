"""Row for row comparison of a query with its SQL on the small tables."""

from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def engine(directory: str = SMALL):
    con = duckdb.connect()
    for p in Path(directory).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return "null" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


def assert_same(spark, query, sql, directory: str = SMALL):
    df = query(spark, directory)
    names = sorted(df.columns)
    rel = engine(directory).sql(sql)
    assert sorted(rel.columns) == names
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())
    assert ours == theirs
