"""Every registered query against its SQL twin, values and types."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from loadweave.plans import oracle, registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL_TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_a_twin():
    assert set(registry.all_queries()) == set(oracle.all_sql())
    assert set(oracle.all_sql()) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", list(registry.all_queries()))
def test_query_matches_sql(spark, duck, name):
    sql = driver.oracle_sql()[name]
    df = driver.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = duck.execute(sql)
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    types = {n: str(t) for n, t, *_ in duck.execute(f"DESCRIBE {sql}").fetchall()}
    assert {f.name: SQL_TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    expected = [tuple(r[at.index(c)] for c in columns) for r in duck.execute(sql).fetchall()]
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 1
