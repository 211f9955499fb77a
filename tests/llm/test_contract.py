"""Registered queries against their SQL, and the registry."""

import duckdb
import pytest
import __spark_entry__ as contract
from folioscope.llm.registry import ORACLES, QUERIES


def test_every_operator_has_a_query():
    names = contract.queries()
    assert {n.partition("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) <= set(names) and "pipeline" in names and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    from tools.check_queries import TABLES, compare

    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    message, good = compare(spark, con, name, QUERIES[name], ORACLES[name], sf)
    assert good, message
