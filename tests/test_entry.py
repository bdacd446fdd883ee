import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from strandframe.plans import data_queries, interval_queries
from tools.compare import canonical, views


def test_names_and_oracles():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {"p1_found", "p2_found", "p4_found", "p6_found"} <= names


def test_entry(spark, sf_dir):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["kind", "sample", "chrom", "fiber_int_id", "from_pos", "to_pos"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", [*interval_queries.ORACLES, *data_queries.ORACLES])
def test_query_equals_its_sql(spark, sf_dir, con: duckdb.DuckDBPyConnection, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_queries_without_sql_run(spark, sf_dir):
    for name in ("coaccess_ranked", "multiset_fingerprint"):
        assert isinstance(entry.queries()[name](spark, sf_dir).toPandas(), pd.DataFrame)
