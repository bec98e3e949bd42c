"""Every registered query against its SQL, and on empty tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import SCHEMAS, TABLES, compare

SMALL = "/root/testdata/sf0.001"
QUERIES = {name: build for name, build in entry.queries().items() if name not in entry.LLM_QUERIES}
ORACLES = {name: sql for name, sql in entry.oracle_sql().items() if name not in entry.LLM_QUERIES}


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for table in TABLES:
        spark.read.parquet(f"{SMALL}/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_folder, name):
    schema = SCHEMAS.get(name) or QUERIES[name](spark, SMALL).schema.simpleString()
    empty = QUERIES[name](spark, empty_folder)
    assert empty.schema.simpleString() == schema
    empty.collect()
