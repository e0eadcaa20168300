"""Holds a query against its SQL in DuckDB over the same files."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if hasattr(x, "tolist"):
        return plain(x.tolist()) if not isinstance(x.tolist(), list) else tuple(map(plain, x.tolist()))
    return x


def rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pdf[cols].notna(), None)
    return cols, sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


def assert_same(df, con, sql):
    got, want = rows(df.toPandas()), rows(con.execute(sql).fetchdf())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1], strict=True):
        assert [str(x) for x in a] == [str(x) for x in b] or a == b
