"""Runs a query and its SQL side by side, as the driver does."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run_sql(sql, sf_dir=DATA):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con.sql(sql).df()


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for k in frame.columns:
        if str(frame[k].dtype).lower().startswith("int"):
            frame[k] = frame[k].astype("int64")
    return sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))


def assert_same(spark, query, sql, sf_dir=DATA):
    ours, theirs = query(spark, sf_dir).toPandas(), run_sql(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
