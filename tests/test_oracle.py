"""Every registered query against its DuckDB oracle at sf0.01 (the driver's correctness gate)."""

import pytest

import __spark_entry__ as entry_mod
from conftest import SF001, SF01
from oracle_compare import compare, duck

QUERIES = entry_mod.queries()
SQL = entry_mod.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


# Spark type → DuckDB type of the same column (schemas must agree, not only values)
SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    rel = con.sql(SQL[name])
    spark_types = {f.name: SAME_TYPE.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types, f"{name}: schema {spark_types} vs {duck_types}"
    ok, msg = compare(df.toPandas(), rel.df())
    assert ok, f"{name}: {msg}"


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["segment", "a_id", "a_region", "b_id", "b_region", "similarity"]
    assert df.count() > 0


def test_every_query_has_a_callable(spark):
    assert set(SQL) <= set(QUERIES)
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, SF001).count() > 0, name
