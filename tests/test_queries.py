"""Every registered query against its SQL, and its column types."""

import pytest
from folio import registry

from tests.oracle import connection, rows

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def sf(request):
    return f"/root/testdata/{request.param}"


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", registry.ORACLES)
def test_rows_equal_sql(spark, sf, con, name):
    df, relation = registry.QUERIES[name](spark, sf), con.sql(registry.ORACLES[name])
    types = dict(zip(relation.columns, map(str, relation.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes if t in TYPES} == {c: types[c] for c, t in df.dtypes if t in TYPES}
    want = rows(relation.df())
    assert rows(df.toPandas()) == want and len(df.columns) == len(relation.columns)
    assert want or sf.endswith("0.001")


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLES])
def test_the_others_run(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
