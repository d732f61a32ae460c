"""Every registered query that has SQL, against DuckDB on the same tables."""

import duckdb
import pytest

import __spark_entry__
from millrace.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def bag(frame, columns):
    plain = frame[columns].astype(object)
    return sorted(map(str, plain.where(plain.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours, sorted(ours.columns)) == bag(theirs, sorted(ours.columns))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["word", "cnt"] and df.limit(1).count() == 1
