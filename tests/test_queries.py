"""Every bound query against its SQL twin on the smallest given data."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import entry, oracle_sql, queries
from priorline.catalog.bindings import TABLES
from tools.compare import SAME, compare

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given data is not here")
@pytest.mark.parametrize("name", [n for n in queries() if n in oracle_sql()])
def test_query_equals_sql(spark, duck, name):
    outcome = compare(spark, duck, name, queries()[name], oracle_sql().get(name), FOLDER)
    assert outcome[0].startswith(("ok", "rows only")), outcome[0]
    if len(outcome) == 4:
        spark_types, duck_types = outcome[2], outcome[3]
        wrong = {c: (k, duck_types[c]) for c, k in spark_types.items() if duck_types[c] not in SAME[k]}
        assert not wrong


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the given data is not here")
def test_entry_runs(spark):
    assert entry(spark).limit(1).count() == 1


def test_every_query_of_the_reference_operators_has_sql():
    from priorline.catalog import REGISTRY

    assert all(q.sql for q in REGISTRY.values())
