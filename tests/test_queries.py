"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return c


def plain(rows, columns):
    """Rows as text, so that 1 and 1.0 and a null of any kind compare."""

    def cell(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return f"{x:.6f}" if isinstance(x, float) else str(int(x)) if isinstance(x, bool) else str(x)

    return sorted(tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, f"{DATA}/sf0.001")
    theirs = duck.sql(catalogue.SQL[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain([tuple(r) for r in ours.collect()], ours.columns) == plain(theirs.fetchall(), theirs.columns)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "qid"
