"""Every query runs, and gives the rows of its SQL, on the smallest tables."""

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quaylight.plans import core_queries, core_sql


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return c


def rows(cols, names, data):
    return sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in data)


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, db, sf, name):
    df = core_queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    cols = sorted(df.columns)
    if name in core_sql():
        res = db.execute(core_sql()[name])
        names = [x[0] for x in res.description]
        assert sorted(names) == cols
        assert rows(cols, df.columns, got) == rows(cols, names, res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_does_not_know_the_llm_subpackage():
    root = Path(__file__).resolve().parents[1] / "quaylight"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"\bllm\b", p.read_text())
