"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""
import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
from caselens.sources.files import file_inventory
from check import TABLES, _rows

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    relation = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(
        relation.columns, relation.fetchall())


def test_inventory_equals_hashlib(spark):
    got = {os.path.basename(r.path): r.sha256 for r in file_inventory(spark, FOLDER).collect()}
    assert {f: h for f, h in got.items() if f.endswith(".parquet")} == {
        f: hashlib.sha256(open(f"{FOLDER}/{f}", "rb").read()).hexdigest()
        for f in os.listdir(FOLDER) if f.endswith(".parquet")}


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
