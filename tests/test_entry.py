"""Driver contract and every query with SQL against DuckDB at the smallest scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from packetloom.plans.catalogue import load_all
from tests.oracle import compare, connect

ENTRIES = load_all()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_flagship_query(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["protocol", "packet_count", "byte_count", "percentage", "byte_percentage", "avg_packet_size", "rank"]


def test_contract_shapes():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_query_equals_sql(spark, duck, sf_dir, name):
    item = ENTRIES[name]
    df = item.build(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    result = duck.execute(item.sql)
    assert compare(rows, df.columns, result.fetchall(), [d[0] for d in result.description]) is None


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if not e.sql])
def test_query_without_sql_runs(spark, sf_dir, name):
    assert ENTRIES[name].build(spark, sf_dir).count() > 0
