"""The entry points of the driver, and queries against SQL on the smallest tables."""

import importlib

import duckdb
import pytest

import __spark_entry__ as entry
import verify
from tests.conftest import DATA
from vitrail.plans import data_queries, reference_queries


@pytest.fixture(scope="module")
def connection():
    import os

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["vec_id", "similarity"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p4_found", "p5_found"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted({**reference_queries.ORACLE, **data_queries.ORACLE}))
def test_against_sql(spark, connection, name):
    df = entry.queries()[name](spark, DATA)
    found = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    mine = sorted((tuple(verify.canonical(r[c]) for c in sorted(columns)) for r in df.collect()), key=str)
    theirs = sorted((tuple(verify.canonical(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=str)
    assert mine == theirs


def test_rest_works_without_the_training_data_package(monkeypatch):
    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    names = set(entry.queries())
    assert "p4_found" in names and "p1_found" not in names
