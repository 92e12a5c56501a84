"""Every registered query runs next to its SQL on the smallest tables."""

import duckdb
import pytest

from check import compare
from workload import ORACLE, QUERIES
from workload.base import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    verdict = compare(got, sql.execute(ORACLE[name]).df())
    assert verdict == "ok", verdict


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
