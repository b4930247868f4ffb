"""Queries against their SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from cairnbook.plans.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry_and_queries_without_sql(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(SQL) <= set(QUERIES)
    for name in ("l1_route_and_intent", "m3_apply_rules", "e13_disposition_counts", "a21_archive_members", "a24_sniffing", "streaming_job_states", "v5_discovery_chunks"):
        assert QUERIES[name](spark, DIR).count() > 0
