"""Holds a query's rows against its SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([_plain(r[i]) for i in order] for r in found), key=repr)


def compare(spark, query, sql, data=DATA):
    df = query(spark, data)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got, want = rows(df.columns, [tuple(r) for r in df.collect()]), rows(names, cur.fetchall())
    assert len(got) == len(want) and got == want, (len(got), len(want), [x for x in zip(got, want) if x[0] != x[1]][:3])
    return len(got)
