"""Registered queries: all there, and equal to their SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as E
from newsfeat.llm import registry
from scripts.check_oracle import TABLES, digest
from tests.conftest import SF_SMALL


def test_all_are_registered():
    names = set(registry.queries())
    assert {int(n.split("_")[0][2:]) for n in names} == set(range(1, 14))
    assert names | {"pipeline"} <= set(E.queries()) and set(registry.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    got = digest(registry.queries()[name](spark, SF_SMALL).toPandas())
    want = digest(con.execute(registry.oracle_sql()[name]).df())
    assert got[:3] == want[:3]
