"""Each catalogue query against its SQL, and the entry module."""

import duckdb
import pytest
from conftest import SMALL

from termweave.plans import catalog

#: Their plans are those of queries that run here, at several times the cost.
LONG = {"match_unfiltered", "match_fr", "filter_levenshtein", "longest_annotation"}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in "part documents conversations lineitem embeddings benchmark".split():
        connection.execute(f"create view {name} as select * from read_parquet('{SMALL}/{name}.parquet')")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - LONG))
def test_query_equals_its_sql(spark, tables, name):
    result = catalog.QUERIES[name](spark, SMALL)
    expected = tables.execute(catalog.ORACLES[name]).df()
    rows = [tuple(r) for r in result.collect()]
    columns = list(expected.columns)
    assert sorted(result.columns) == sorted(columns)
    theirs = [tuple(None if v != v else v.item() if hasattr(v, "item") else v for v in r) for r in expected.itertuples(index=False, name=None)]
    assert comparable(rows, result.columns) == comparable(theirs, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
